"""The operators against SQL, brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from canonry.llm import decontam, exact_dedup, html_extract, langid, ngram_join, packing, queries, sharding, substring_dedup, token_file, toxicity
from canonry.llm.tokens import Encoder, default_vocabulary
from canonry.plans.scratch import new_path
from tests.conftest import DATA, rows_of

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, doc string, kept boolean, n long, slot string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", "x", None, 1, "y") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "One"), (5, "one"), (5, "one"), (None, "null id"), (6, LONG), (7, LONG.upper()), (8, "🙂 é ß"), (9, "a  b   c"), (10, "12 34 !!")]


@pytest.mark.parametrize("name", ["op4_ngram_join", "op8_shard", "op10_exact_dedup"])
def test_query_equals_sql(spark, duck, name):
    got = rows_of(queries.queries()[name](spark, f"{DATA}/sf0.01").toPandas())
    assert got == rows_of(duck.execute(queries.oracle_sql()[name]).df())


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, text string")


def test_odd_rows_language(spark):
    docs = frame(spark, ODD)
    model = langid.fit(docs)
    got = langid.identify(docs, model, with_spans=True).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(frame(spark, []), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(frame(spark, []))).collect()} == {"und"}


def test_language_held_out_and_spans(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = langid.query(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    model = langid.fit(docs)
    by = {r.lang: r.text for r in docs.where("length(text) between 400 and 600").orderBy("doc_id").collect()}
    text = by["de"] + " " + by["fr"]
    spans = model.spans(text)
    assert [x for *_, x in spans] == ["de", "fr"]
    assert abs(spans[0][1] - len(by["de"])) < 30 and spans[1][1] <= len(text)


def test_script_narrows_candidates():
    table = np.zeros((langid.BUCKETS, 2), np.float32)
    allowed = np.zeros((len(langid.NAMES), 2), bool)
    allowed[langid.NAMES.index("Cyrillic"), 1] = allowed[langid.NAMES.index("Latin"), 0] = True
    assert langid.Model(["en", "ru"], table, allowed).label(["привет мир", "hello world", None]) == [("ru", 1.0), ("en", 1.0), ("und", 0.0)]


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.log(rng.random((langid.BUCKETS, 3)).astype(np.float32)), np.ones((len(langid.NAMES), 3), bool))
    texts = [["w" + chr(97 + k) for k in rng.integers(0, 26, n)] for n in (0, 1, 5, 40, 300)]
    for words, got in zip(texts, model.path(texts)):
        if not words:
            assert len(got) == 0
            continue
        s = model.scores[model.word_rows(words)].astype(float)
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - langid.PENALTY * sum(a != b for a, b in zip(p, p[1:]))
        v, back = s[0].copy(), []
        for row in s[1:]:
            step = v[:, None] - langid.PENALTY * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            v = step.max(axis=0) + row
        assert abs(cost(got.tolist()) - v.max()) < 1e-2


def test_toxicity_learns_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.query(spark, f"{DATA}/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.95 and hit / sum(r.toxic for r in rows) > 0.55


def test_odd_rows_toxicity(spark):
    docs = frame(spark, ODD)
    w = toxicity.fit(docs, labels_of(spark, [(4, 1, "z"), (6, 0, "z"), (5, None, "z"), (None, 1, "z"), (99, 1, "z")]))
    got = toxicity.score(docs, w).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(frame(spark, []), w).count() == 0
    assert len(toxicity.fit(docs, labels_of(spark, [])).index) == 0


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    rows = [(np.append(rng.choice(5000, 50, replace=False) + 10, int(y)), int(y)) for y in rng.random(600) < 0.3]
    w = toxicity.ftrl(rows)
    assert 0 < len(w.index) < 500 and w.value[w.index == 1][0] > 1


def plain_words(t):
    return re.findall(r"\w+", (t or "").lower())


def test_leaks_equal_containment(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    items = [(i, " " + " ".join(plain_words(t)) + " ") for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in docs for i, x in items if x in " " + " ".join(plain_words(t)) + " "}
    got = {(r.doc_id, r.item_id) for r in decontam.query(spark, f"{DATA}/sf0.01").collect()}
    assert want <= got and len(got - want) <= 2


def test_leaks_paraphrase_and_odd_rows(spark, duck):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    i, t = duck.execute("SELECT item_id, text FROM benchmark WHERE len(string_split(text, ' ')) > 40 ORDER BY item_id LIMIT 1").fetchone()
    w = t.split()
    changed = " ".join("zzz" if k % 8 == 3 else x for k, x in enumerate(w))
    clean = docs.orderBy("doc_id").first().text
    rows = docs.unionByName(spark.createDataFrame([(9001, f"{clean} {changed} {clean}"), (9002, None), (9003, ""), (None, t), (9004, "!!")], "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t, 0), (77, None, 0), (None, "x", 0), (78, "..", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(rows, bench).collect()}
    assert (9001, i) in got and all(d is not None for d, _ in got)
    assert decontam.find_leaks(rows.limit(0), bench).count() == 0 and decontam.find_leaks(rows, bench.limit(0)).count() == 0


def test_common_subsequence_brute_force():
    rng = np.random.default_rng(2)
    space = decontam.Space(np.ones((decontam.BUCKETS, 2), np.float32), np.ones(decontam.BUCKETS))
    for _ in range(30):
        a, b = (rng.integers(0, 6, rng.integers(1, 20)).tolist() for _ in range(2))
        item = decontam.make_items([(1, " ".join(f"w{x}" for x in a))], space)[0]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(item, decontam.words_of(" ".join(f"w{x}" for x in b)).tolist()) == table[-1][-1]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(5, 80), (3, 90), (2, 50)])
def test_components_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    rows = []
    for f in range(12):
        base = [f"t{x}" for x in rng.integers(0, 300, rng.integers(3, 120))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(w)))
    many = [f"m{i}" for i in range(200)]
    for j in range(90):  # one large group of near copies
        rows.append((len(rows), " ".join([*many[: j + 1], f"q{j}", *many[j + 2 :]])))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a", "A", "a b"])]
    got = {tuple(r) for r in ngram_join.components(frame(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("k,percent,edits", [(3, 90, 6), (5, 80, 9), (1, 80, 16)])
def test_large_groups_of_near_copies(spark, k, percent, edits, monkeypatch):
    """Groups far beyond FEW, in two versions, whose members link with some of the others only."""
    rng = np.random.default_rng(edits)
    rows = []
    for version in range(2):
        base = [f"t{x}" for x in range(120)]
        base[40:46] = [f"v{version}{x}" for x in range(6)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.integers(1, edits)):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(ngram_join, "FEW", 8)
    want = brute_components(rows, k, percent)
    assert 1 < len({c for *_, c in want}) < len(rows)
    assert {tuple(r) for r in ngram_join.components(frame(spark, rows), k, percent).collect()} == want


def test_odd_rows_components(spark):
    got = {r.doc_id: r for r in ngram_join.components(frame(spark, ODD), 3, 90).collect()}
    assert got[7].component_id == 6 and got[5].component_id == 4 and got[1].component_id == 1 and got[None].component_id is None
    assert ngram_join.components(frame(spark, [])).count() == 0


def test_sketch_bounds_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 200)], rng.integers(0, 1 << 62, 20).astype(np.uint64)]))
        apart = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def library_ids(text, end):
    from tokenizers import Tokenizer

    tok = library_ids.tok = getattr(library_ids, "tok", None) or Tokenizer.from_file(default_vocabulary())
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("source", ["odd", "sf0.001"])
def test_token_files_round_trip(spark, source):
    docs = frame(spark, ODD) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want, n = [], 0
    for d in sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id, d.text or "")):
        ids = library_ids(d.text, 2)
        want.append((d.doc_id, n, len(ids), zlib.crc32(ids.tobytes())))
        n += len(ids)
    manifest = token_file.write_token_files(docs, new_path(spark, "tokens"))
    rows = token_file.read_token_files(manifest, token_file.documents_of, "doc_id long, start long, n_tokens long, ids_crc32 long, base long, shard long")
    assert sorted(((r.doc_id, r.base + r.start, r.n_tokens, r.ids_crc32) for r in rows.collect()), key=lambda r: r[1]) == want
    assert token_file.write_token_files(docs.limit(0), new_path(spark, "tokens")).count() == 0


def test_token_file_reads_only_what_is_asked_and_sees_damage():
    docs = [(i, np.arange(i * 1000, dtype="<u2").tobytes()) for i in range(400)] + [(400, b"")]
    out = io.BytesIO()
    told = token_file.write_file(out, docs, "<u2")
    f = token_file.TokenFile(out)
    assert told["frames"] == len(f.frames) > 100 and [i for i, *_ in f.read()] == [i for i, _ in docs]
    seen = []
    read = f.frame
    f.frame = lambda k: seen.append(k) or read(k)
    (got,) = f.read(f.find(399))
    assert got[2].tobytes() == docs[399][1] and len(seen) == 1
    raw = bytearray(out.getvalue())
    raw[int(f.place[seen[0]]) + 40] ^= 1
    with pytest.raises(Exception):
        list(token_file.TokenFile(io.BytesIO(bytes(raw))).read([399]))
    empty = io.BytesIO()
    token_file.write_file(empty, [], "<u2")
    assert list(token_file.TokenFile(empty).read()) == []


def test_encoder_equals_library():
    rng = random.Random(5)
    parts = ["a", "b", "word", "word,", "abc.", "x!!", "ab*$$,", "A.b,", " x", " y", " ", " ", " ", "  ", "\xa0", "\u3000", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u1680", "\u2009", "\u2028", "\u200b", "\u180e", "\ufeff", "é", "ß", "漢", "字", "1", "23", "½", "'s", "'ll", "don't", "<|endoftext|>", "<|", "🙂", "e\u0301", "ก", "_", "-", "\x00"]
    texts = [t for _, t in ODD] + ["x\n a ", "x ", "x\n "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    enc = Encoder(default_vocabulary(), remembered=2000)
    for k in range(0, len(texts), 500):
        ids, at = enc.encode(pa.array(texts[k : k + 500]), 7)
        for i, t in enumerate(texts[k : k + 500]):
            assert ids[at[i] : at[i + 1]].tolist() == library_ids(t, 7).tolist(), repr(t)
    ids, at = enc.encode(pa.array([], pa.string()), 7)
    assert len(ids) == 0 and at.tolist() == [0]


@pytest.mark.parametrize("source", ["odd", "sf0.001"])
def test_packing_holds_every_token_once(spark, source):
    docs = frame(spark, [(i, t) for i, t in ODD if i != 5]) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: library_ids(r.text, 0) for r in docs.collect()}
    rows = packing.pack(docs.repartition(5)).collect()
    at, seqs = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[i] == len(x) for i, x in ids.items())
    for pieces in seqs.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 1024
    assert sum(sum(n for _, n in p) < 1024 for p in seqs.values()) <= 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_rows_that_repeat_an_id(spark):
    rows = packing.pack(frame(spark, [(5, "one"), (5, "one"), (5, "two words here"), (None, LONG), (None, None)])).collect()
    assert sum(r.length for r in rows) == sum(len(library_ids(t, 0)) for t in ("one", "one", "two words here", LONG, None))
    assert sorted(r.doc_tokens for r in rows if r.doc_id == 5) == sorted(len(library_ids(t, 0)) for t in ("one", "one", "two words here"))


def test_repeats_found_and_clean_left_alone(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    passage = [" ".join(word() for _ in range(55)) for _ in range(20)]
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(60)]
    planted = {}
    for p, t in enumerate(passage):
        for d in (p, p + 20):
            rows[d] = (d, rows[d][1][:300] + " " + t + " " + rows[d][1][300:])
        planted[p + 20] = p
    got = substring_dedup.find_repeats(frame(spark, [*rows, (None, passage[0]), (900, None), (901, "")])).collect()
    assert {r.doc_id for r in got} == set(planted) and all(r.first_doc_id == planted[r.doc_id] for r in got)
    text = dict(rows)
    for r in got:
        assert text[r.doc_id][r.start : r.end].strip() in text[r.first_doc_id]
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert all((len(left[i]) < len(t) - 100) == (i in planted) for i, t in rows)
    assert substring_dedup.find_repeats(frame(spark, [])).count() == 0


def test_chunks_resist_shifts():
    t = LONG[:20_000]
    a, b = (set(substring_dedup.chunks(x)[0].tolist()) for x in (t, "inserted words here " + t))
    assert len(a - b) <= 3


def test_shards_even_and_stable(spark):
    table = sharding.lookup_table()
    counts = np.bincount(table, minlength=64)
    assert counts.max() - counts.min() <= 1 and -1 not in table
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, less) if a != 63)
    assert moved < 0.25 * len(table)
    got = sharding.assign_shards(frame(spark, ODD), "doc_id").collect()
    assert len(got) == len(ODD) and all(r.shard in sharding.SHARDS for r in got)
    plan = sharding.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


PAGES = [
    ("<html><body><header>Site</header><nav><a href=x>Home</a></nav><main><h1>T &amp; U</h1><p>One\n two<p>Three <b>four</main><footer>f</footer>", "T & U\nOne two\nThree four"),
    ('<div class="cookie-notice">We use cookies, accept them all</div><div class="content"><h2>Head</h2><p>Body text of the page that is long enough.</p></div><div id="comments"><p>Nice post!</p></div>', "Head\nBody text of the page that is long enough."),
    ('<article><h1>A</h1><p>First part here.</p><div class="ad">Buy now cheap</div><p>Second part.</p><form><input><label>Mail</label></form></article><aside>Related stuff</aside>', "A\nFirst part here.\nSecond part."),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style>", ""),
    ("", ""),
    (None, ""),
    ("<article><p>cut off in a ta<", "cut off in a ta<"),
    ("plain text without tags", "plain text without tags"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_extract(page, text):
    assert html_extract.extract(page) == text


def test_extract_pages_and_labelled_pages(spark):
    assert all(html_extract.extract(p) == "\n".join(m) for p, m in html_extract.labelled_pages())
    rows = spark.createDataFrame([(i, None, p, "t") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(rows).collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, (_, t) in enumerate(PAGES))
    assert html_extract.extract_pages(rows.limit(0)).count() == 0


def test_digest_index_persists(spark):
    index = exact_dedup.fresh_index(spark)
    first = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, ODD), index).collect() if r.doc_id in (1, 2, 4, 5)}
    assert first == {(1, 2, 2, False), (2, 2, 2, True), (4, 5, 3, False), (5, 5, 3, True)}
    later = exact_dedup.exact_dedup(frame(spark, [(50, "ONE"), (51, "new"), (52, None)]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in later} == {(50, 5, False), (51, 51, True), (52, 2, False)}
    assert next(r for r in later if r.doc_id == 51).text_sha256 == hashlib.sha256(b"new").hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, []), index).count() == 0
    kept = exact_dedup.drop_duplicates(frame(spark, ODD), exact_dedup.fresh_index(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 3, 5, 7, 8, 9, 10] and len(kept) == 8
    spark.sql(f"DROP TABLE {index.name}")


def test_pipeline_equals_its_parts_by_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.reject_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = {}
    for r in kept.collect():
        rows.setdefault("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""), []).append((r.doc_id, r.text))
    unique = sorted(max(x) for x in rows.values())
    dedup = P.one_of_equal(spark, kept, SF)
    assert sorted(r.doc_id for r in dedup.collect()) == [i for i, _ in unique]
    near = P.one_of_similar(spark, dedup, SF)
    stay = sorted(i for i, _, c in brute_components(unique, 5, 80) if i == c)
    assert sorted(r.doc_id for r in near.collect()) == stay and near.columns == docs.columns
    assert len(P.STAGES) == 5
