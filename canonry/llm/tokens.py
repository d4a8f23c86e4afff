"""Token ids of whole texts, with the pieces between spaces remembered."""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a task.
REMEMBERED = 250_000
#: Bytes of texts that are encoded at a time, as what is needed meanwhile is many times as large.
TOGETHER = 1 << 20
#: Pieces whose ids are laid out at a time.
LAID_OUT = 1 << 18
#: Marks that are neither letters, numbers nor white space; an apostrophe may begin a contraction and is not among them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How byte-level tokenizers spell bytes: printable ones as they are, the others in order from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
MEANT = {c: b for b, c in SPELLED.items()}
SPELLING = np.array([ord(SPELLED.get(b, chr(b))) for b in range(256)], "<u2")
#: Runs of letters below U+0250, and how many go to the model at once.
LATIN = "\\A[A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]+\\z"
JOINED = 128
_SPACE = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts in which a space (U+0020) stands before other white space, or after it at the end.
UNEVEN = f" [{_SPACE}]|[{_SPACE}] \\z"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


def _spans_letters(token: str) -> bool:
    """The token holds a space behind what may be (part of) letters; behind white space or marks alone it does not matter."""
    for run in token.split("Ġ")[:-1]:
        raw = bytes(MEANT.get(c, ord(c) & 255) for c in run)
        try:
            if any(c.isalpha() for c in raw.decode()):
                return True
        except UnicodeDecodeError:
            return True
    return False


class Encoder:
    """Encodes whole texts with a file of the tokenizers library, without special tokens.

    Byte-level tokenizers that split by the usual pattern always start a new piece at a space that stands before a
    non-space. So a text whose spaces all stand so is cut at its spaces and each piece is looked up; the library encodes
    the pieces not seen before. Texts with other white space beside a space or with one of the file's added tokens, and
    other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocabulary.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.starts_piece = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts_piece[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        model = spec.get("model", {})
        self.letters = self.by_piece and model.get("type") == "BPE" and not model.get("dropout") and not any(map(model.get, ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))) and not any(map(_spans_letters, vocabulary))
        self.model = Tokenizer(self.tok.model) if self.letters else None
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Forget all pieces: at a task's end, as its worker is kept."""
        self.rows: dict[str, int] = {}  # pieces, with the space before them
        self.heads: dict[str, int] = {}  # first pieces of texts
        self.ids = np.empty(1 << 16, self.dtype)
        self.begin, self.size, self.count = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.n, self.n_ids = 0, 0

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append rows of these sizes; returns the first one's number."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.size, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.count))
        first, at = self.n, slice(self.n, self.n + len(sizes))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[at] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at], self.count[at] = sizes, 0
        self.n, self.n_ids = self.n + len(sizes), self.n_ids + len(ids)
        return first

    def _whole(self, texts: list[str]) -> int:
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return self._store(np.array([i for x in lists for i in x], self.dtype), np.array([len(x) for x in lists], np.int64))

    def _letters(self, pieces: list[str]) -> None:
        """Remember runs of letters. Each is one pre-token and the model joins nothing across a space, so many go to it as one."""
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            spelled = [SPELLING[np.frombuffer((" " + " ".join(part[i : i + JOINED])).encode(), np.uint8)].tobytes().decode("utf-16-le") for i in range(0, len(part), JOINED)]
            self._remember(part, [e.ids for e in self.model.encode_batch_fast(spelled, add_special_tokens=False)])

    def _remember(self, pieces: list[str], lists: list[list[int]]) -> None:
        """Remember pieces of which the ids are given one after the other, each with its space before it."""
        ids = np.array(list(chain.from_iterable(lists)), self.dtype)
        (at,) = np.nonzero(self.starts_piece[ids])
        if len(at) != len(pieces):
            raise RuntimeError("a piece does not start at its space")
        first = self._store(ids, np.diff(np.append(at, len(ids))))
        self.rows.update(zip(pieces, range(first, first + len(pieces))))

    def _learn(self, pieces: list[str]) -> None:
        """Remember new pieces. Marks behind a letter are a pre-token of their own, so a piece is its core and its marks."""
        rows, cores, split = self.rows, pieces, []
        plain, cores = self._parted(cores)
        other, trimmed = [], _strings(pc.utf8_rtrim(pa.array(cores, pa.large_string()), MARKS))
        for w, core in zip(cores, trimmed):
            if not w:  # a space at a text's end
                rows[w] = self._whole([" "])
            elif core and len(core) < len(w) and core[-1].isalpha():
                split.append((w, core))
            else:
                other.append(w)
        known = {*plain, *other}
        more, rest = self._parted([c for c in dict.fromkeys(c for _, c in split) if c not in rows and c not in known])
        self._letters(plain + more)
        other += rest
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            self._remember(part, [e.ids for e in self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)])
        if split:
            marks = [w[len(c) :] for w, c in split]
            if fresh := [m for m in dict.fromkeys(marks) if m not in self.heads]:
                first = self._whole(fresh)
                self.heads.update(zip(fresh, range(first, first + len(fresh))))
            two = np.array([[rows[c] for _, c in split], [self.heads[m] for m in marks]]).T.ravel()
            size = self.size[two]
            at = np.cumsum(size) - size
            first = self._store(self.ids[np.repeat(self.begin[two] - at, size) + np.arange(int(size.sum()))], size.reshape(-1, 2).sum(axis=1))
            rows.update(zip([w for w, _ in split], range(first, first + len(split))))

    def _parted(self, pieces: list[str]) -> tuple[list[str], list[str]]:
        """Runs of Latin letters, if the model takes them as they are, and the rest."""
        if not self.letters or not pieces:
            return [], pieces
        text = pa.array(pieces, pa.large_string())
        plain = pc.match_substring_regex(text, LATIN)
        return _strings(text.filter(plain)), _strings(text.filter(pc.invert(plain)))

    def _make_room(self) -> None:
        """Forget the pieces met less than three times, or all if that is not half of them."""
        keep = self.count[: self.n] > 2
        if 2 * keep.sum() > self.n:
            self.forget()
            return
        rows, heads, ids, begin, size = self.rows, self.heads, self.ids, self.begin[: self.n], self.size[: self.n]
        (old,) = np.nonzero(keep)
        self.forget()
        at = np.cumsum(size[old]) - size[old]
        self._store(ids[np.repeat(begin[old] - at, size[old]) + np.arange(int(size[old].sum()))], size[old])
        new = np.cumsum(keep) - 1
        for now, before in ((self.rows, rows), (self.heads, heads)):
            now.update((w, int(new[r])) for w, r in before.items() if keep[r])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with end_id behind it, and where each text begins (n + 1 places).

        None counts as empty.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ids, places, n = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)], 0
        upto, k = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while k < len(texts):
            e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + TOGETHER, "right")))
            some, place = self._encode(texts.slice(k, e - k), end_id)
            ids.append(some)
            places.append(place[1:] + n)
            n, k = n + len(some), e
        return np.concatenate(ids), np.concatenate(places)

    def _encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts, none of them None, that are laid out together."""
        if self.n > self.remembered:
            self._make_room()
        if self.by_piece:
            whole = pc.match_substring_regex(texts, UNEVEN)
            for t in self.added:
                whole = pc.or_(whole, pc.match_substring(texts, t))
        else:
            whole = pa.array(np.ones(len(texts), bool))
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        at = parts.offsets.to_numpy()
        values = parts.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        begins = at[:-1]
        coded = values.dictionary_encode()
        of = coded.indices.to_numpy()
        heads = values.take(pa.array(begins)).to_pylist()
        tail = np.ones(len(of), bool)
        tail[begins] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[of[tail]] = True
        (used,) = np.nonzero(used)
        words = _strings(coded.dictionary.take(pa.array(used)))
        rows = self.rows
        found = list(map(rows.get, words))
        if None in found:
            self._learn([w for w, r in zip(words, found) if r is None])
            found = [rows[w] if r is None else r for w, r in zip(words, found)]
        if fresh := [h for h in dict.fromkeys(heads) if h not in self.heads]:
            first = self._whole(fresh)
            self.heads.update(zip(fresh, range(first, first + len(fresh))))
        row_of = np.zeros(len(coded.dictionary), np.int64)
        row_of[used] = np.array(found, np.int64)
        kept, kept_ids = self.n, self.n_ids
        end = self._store(np.array([end_id], self.dtype), np.ones(1, np.int64))
        own = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        (odd,) = np.nonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            own[odd] = self._whole(texts.take(pa.array(odd)).to_pylist()) + np.arange(len(odd))
        row = row_of[of]
        self.count[: self.n] += np.bincount(row, minlength=self.n)[: self.n]
        row[begins] = own
        row = np.insert(row, at[1:], end)
        place = np.concatenate([[0], np.cumsum(self.size[row])])
        out = np.empty(int(place[-1]), self.dtype)
        for k in range(0, len(row), LAID_OUT):
            r = row[k : k + LAID_OUT]
            size, a = self.size[r], place[k]
            n = int(place[min(k + LAID_OUT, len(row))] - a)
            out[a : a + n] = self.ids[np.repeat(self.begin[r] - (place[k : k + len(r)] - a), size) + np.arange(n)]
        self.n, self.n_ids = kept, kept_ids  # the end and whole texts are not remembered
        return out, place[np.append(at + np.arange(len(at)), 0)[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)
