"""What encoding holds at once does not follow the size of a batch."""

import tracemalloc

import pyarrow as pa
from tokenizers import Tokenizer

from canonry.llm.tokens import Encoder, default_vocabulary


def test_a_large_batch_is_encoded_in_slices():
    texts = [" a b c d" * 400, None, "one  two ", "", " x\n y"] * 1300
    enc, tok = Encoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    batch = pa.array(texts)
    tracemalloc.start()
    ids, at = enc.encode(batch, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts[:5]]
    assert len(at) == len(texts) + 1 and at[-1] == len(ids) == 1300 * sum(map(len, want))
    for i in (0, 1, 2, 3, 4, 3245, 3246, 3247, 3248, 3249, len(texts) - 1):
        assert ids[at[i] : at[i + 1]].tolist() == want[i % 5]
    assert peak < 35 << 20
    assert [len(x) for x in enc.encode(pa.array([], pa.string()), 0)] == [0, 1]
