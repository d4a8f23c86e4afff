"""DuckDB SQL for the queries of the catalogue: common table expressions and one SELECT each."""

from __future__ import annotations

from canonry.functions.text import ANSWER_RULES, CALL_FAILED, NUMBER, PUNCTUATION_CLASS, SUFFIX

CLASS = PUNCTUATION_CLASS.replace("'", "''")
TEMPLATE = "'Do these two values mean the same?' || chr(10) || 'Input:' || chr(10)"
G = "attr, con"


def r(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def subs(t: str) -> str:
    return f"flatten(list_transform(range(1, len({t}) + 1), lambda i: list_transform(range(1, len({t}) - i + 2), lambda n: substring({t}, i, n))))"


def rule(a: str, b: str) -> str:
    last = lambda x: f"string_split(lower({x}), ' ')[-1]"
    return f"CASE WHEN {last(a)} = {last(b)} THEN 'yes' WHEN substr(lower({a}), 1, 1) = substr(lower({b}), 1, 1) THEN 'unsure' ELSE 'no' END"


def judge(a: str, b: str) -> str:
    return f"CASE WHEN lower({a}) = lower({b}) THEN 'yes' ELSE {rule(a, b)} END"


def comps(edges: str, name: str) -> str:
    """CTEs: `name` (attr, con, node, component) of the links `edges` (attr, con, v1, v2)."""
    return f"""
{name}_e AS (SELECT attr, con, v1 AS a, v2 AS b FROM {edges} UNION SELECT attr, con, v2, v1 FROM {edges}),
{name}_r AS (SELECT attr, con, a, a AS b FROM {name}_e UNION SELECT r.attr, r.con, r.a, e.b FROM {name}_r r JOIN {name}_e e ON r.attr = e.attr AND r.con = e.con AND r.b = e.a),
{name} AS (SELECT attr, con, a AS node, min(b) AS component FROM {name}_r GROUP BY attr, con, a)"""


def pieces(name: str, values: str, weighted: bool) -> str:
    v, n = ("lower(value)", "sum(freq)") if weighted else ("value", "count(*)")
    return f"""
{name}_t AS (SELECT {G}, value, freq, unnest(list_filter(regexp_split_to_array({v}, '{CLASS}'), lambda x: x <> '')) AS t FROM {values}),
{name} AS (SELECT {G}, value, piece, CAST({n} AS BIGINT) AS cnt FROM (SELECT {G}, value, freq, unnest({subs('t')}) AS piece FROM {name}_t) GROUP BY {G}, value, piece)"""


def jaccard(name: str, src: str) -> str:
    return f"""
{name}_c AS (SELECT {G}, piece, sum(cnt) AS w FROM {src} GROUP BY {G}, piece),
{name}_w AS (SELECT p.attr, p.con, p.value, p.piece, c.w FROM {src} p JOIN {name}_c c USING (attr, con, piece)),
{name}_s AS (SELECT {G}, value, sum(w) AS w FROM {name}_w GROUP BY {G}, value),
{name}_i AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2, sum(a.w) AS k FROM {name}_w a JOIN {name}_w b ON a.attr = b.attr AND a.con = b.con AND a.piece = b.piece AND a.value < b.value GROUP BY ALL),
{name} AS (SELECT i.attr, i.con, i.v1, i.v2, {r('CAST(i.k AS DOUBLE) / CAST(a.w + b.w - i.k AS DOUBLE)')} AS sim FROM {name}_i i JOIN {name}_s a ON i.attr = a.attr AND i.con = a.con AND i.v1 = a.value JOIN {name}_s b ON i.attr = b.attr AND i.con = b.con AND i.v2 = b.value)"""


def cosine(name: str, src: str) -> str:
    return f"""
{name}_d AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2, sum(a.w * b.w) AS dot FROM {src} a JOIN {src} b ON a.attr = b.attr AND a.con = b.con AND a.piece = b.piece AND a.value < b.value GROUP BY ALL),
{name}_n AS (SELECT {G}, value, sqrt(sum(w * w)) AS norm FROM {src} GROUP BY {G}, value),
{name} AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2, CASE WHEN a.norm * b.norm > 0 THEN {r('coalesce(d.dot, 0) / (a.norm * b.norm)')} ELSE 0 END AS sim
  FROM {name}_n a JOIN {name}_n b ON a.attr = b.attr AND a.con = b.con AND a.value < b.value LEFT JOIN {name}_d d ON d.attr = a.attr AND d.con = a.con AND d.v1 = a.value AND d.v2 = b.value)"""


K = "CAST(floor(sim * 10000 + 0.5) AS BIGINT)"
SIM0 = "LEFT JOIN sims s ON s.attr = {0}.attr AND s.con = {0}.con AND s.v1 = {0}.v1 AND s.v2 = {0}.v2"

CTES = ",".join([
    """
pvals AS (SELECT 'p_name' AS attr, p_type AS con, p_name AS value, count(*) AS freq FROM part GROUP BY p_type, p_name),
vals AS (SELECT * FROM pvals UNION ALL SELECT 'o_orderpriority', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ALL),
emb AS (SELECT 'vec' AS attr, CAST(label AS VARCHAR) AS con, CAST(vec_id AS VARCHAR) AS value, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    pieces("cp", "pvals", True), pieces("cpo", "vals", False), pieces("cpp", "pvals", False), jaccard("sims", "cp"), jaccard("simso", "cpp"),
    f"""
words AS (SELECT {G}, value, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(value, '{NUMBER}', '', 'g')), '{CLASS}'), lambda x: x <> '')) AS word FROM vals),
voc AS (SELECT DISTINCT {G}, word FROM words),
within AS (SELECT a.attr, a.con, a.word, b.word AS piece FROM voc a JOIN voc b ON a.attr = b.attr AND a.con = b.con AND contains(a.word, b.word)),
wp AS (SELECT w.attr, w.con, w.value, c.piece, count(*) AS cnt FROM words w JOIN within c USING (attr, con, word) GROUP BY ALL),
tf AS (SELECT {G}, value, piece, {r('cnt / CAST(sum(cnt) OVER (PARTITION BY attr, con, value) AS DOUBLE)')} AS tf FROM wp),
total AS (SELECT {G}, CAST(sum(freq) AS BIGINT) AS n FROM vals GROUP BY {G}),
wdf AS (SELECT w.attr, w.con, w.piece, CAST(sum(v.freq) AS BIGINT) AS df, any_value(t.n) AS n FROM wp w JOIN vals v USING (attr, con, value) JOIN total t USING (attr, con) GROUP BY w.attr, w.con, w.piece),
idf AS (SELECT {G}, piece, {r('log10(CAST(n AS DOUBLE) / df)')} AS idf FROM wdf),
tfidf AS (SELECT t.attr, t.con, t.value, t.piece, {r('t.tf * i.idf')} AS w FROM tf t JOIN idf i USING (attr, con, piece)),
idfv AS (SELECT w.attr, w.con, w.value, w.piece, i.idf AS w FROM wp w JOIN idf i USING (attr, con, piece))""",
    cosine("tcos", "tfidf"), cosine("icos", "idfv"),
    f"""
pairs AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2 FROM pvals a JOIN pvals b ON a.attr = b.attr AND a.con = b.con AND a.value < b.value),
ecos AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2, {r('list_cosine_similarity(a.e, b.e)')} AS sim FROM emb a JOIN emb b ON a.con = b.con AND a.value < b.value),
links AS (SELECT * FROM sims WHERE sim >= 0.7),
yes AS (SELECT {G}, v1, v2 FROM sims WHERE sim >= 0.5 AND {judge('v1', 'v2')} = 'yes'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY attr, con ORDER BY sim DESC, v1, v2) AS rank FROM sims),
asked AS (SELECT {G}, v1, v2, {TEMPLATE} || v1 || chr(10) || v2 || chr(10) || 'Output:' AS prompt, {rule('v1', 'v2')} AS raw, CASE WHEN length(v1) % 2 = 0 THEN 'cache' ELSE 'new' END AS source FROM sims),
verdicts AS (SELECT {G}, least(lower(v1), lower(v2)) AS k1, greatest(lower(v1), lower(v2)) AS k2, min({rule('v1', 'v2')}) AS answer FROM sims WHERE length(v1) % 2 = 0 GROUP BY ALL),
keyed AS (SELECT *, least(lower(v1), lower(v2)) AS k1, greatest(lower(v1), lower(v2)) AS k2 FROM sims),
missed AS (SELECT k.* FROM keyed k ANTI JOIN verdicts v ON k.attr = v.attr AND k.con = v.con AND k.k1 = v.k1 AND k.k2 = v.k2)""",
    comps("links", "hac"), comps("yes", "closed"),
    f"""
near AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2 FROM emb a JOIN emb b ON a.con = b.con AND a.value < b.value WHERE {r('list_distance(a.e, b.e)')} <= 1.1)""",
    comps("near", "dense"),
    f"""
mem AS (SELECT {G}, ascii(value) AS cluster_id, value FROM pvals),
mp0 AS (SELECT a.attr, a.con, a.cluster_id, a.value AS v1, b.value AS v2 FROM mem a JOIN mem b ON a.attr = b.attr AND a.con = b.con AND a.cluster_id = b.cluster_id AND a.value < b.value),
mp AS (SELECT m.*, coalesce(s.sim, 0) AS sim FROM mp0 m {SIM0.format('m')}),
ends AS (SELECT {G}, cluster_id, v1 AS value, sim FROM mp UNION ALL SELECT {G}, cluster_id, v2, sim FROM mp),
rows_ AS (SELECT {G}, cluster_id, value, sum({K}) AS s, count(*) AS k FROM ends GROUP BY ALL),
cen AS (SELECT {G}, cluster_id, value AS center, {r('CAST(s AS DOUBLE) / k / 10000')} AS ave_sim FROM rows_ QUALIFY row_number() OVER (PARTITION BY attr, con, cluster_id ORDER BY s DESC, value) = 1),
stat AS (SELECT {G}, cluster_id, {r(f'CAST(sum({K}) AS DOUBLE) / count(*) / 10000')} AS all_ave_sim, {r('min(sim)')} AS min_sim FROM mp GROUP BY ALL),
prof AS (SELECT m.attr, m.con, m.cluster_id, m.n, coalesce(c.center, m.first) AS center, s.all_ave_sim, s.min_sim, c.ave_sim
  FROM (SELECT {G}, cluster_id, count(*) AS n, min(value) AS first FROM mem GROUP BY ALL) m LEFT JOIN cen c USING (attr, con, cluster_id) LEFT JOIN stat s USING (attr, con, cluster_id)),
cpair0 AS (SELECT a.attr, a.con, a.cluster_id AS c1, b.cluster_id AS c2, least(a.center, b.center) AS v1, greatest(a.center, b.center) AS v2 FROM prof a JOIN prof b ON a.attr = b.attr AND a.con = b.con AND a.cluster_id < b.cluster_id),
cpair AS (SELECT c.*, coalesce(s.sim, 0) AS sim FROM cpair0 c {SIM0.format('c')}),
intra AS (SELECT {G}, {r('CAST(sum(CAST(floor(ave_sim * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / count(ave_sim) / 10000')} AS a, {r('min(min_sim)')} AS m FROM prof GROUP BY ALL),
inter AS (SELECT {G}, {r(f'CAST(sum({K}) AS DOUBLE) / count(sim) / 10000')} AS inter_ave_sim, {r('min(sim)')} AS inter_min_sim FROM cpair GROUP BY ALL),
gstat AS (SELECT i.attr, i.con, coalesce(i.a, e.inter_ave_sim) AS intra_ave_sim, coalesce(i.m, i.a, e.inter_ave_sim) AS intra_min, e.inter_ave_sim, e.inter_min_sim FROM intra i LEFT JOIN inter e USING (attr, con)),
cand0 AS (SELECT m.attr, m.con, m.cluster_id, m.value, p.center, p.ave_sim, g.intra_ave_sim, least(m.value, p.center) AS v1, greatest(m.value, p.center) AS v2
  FROM mem m JOIN prof p USING (attr, con, cluster_id) JOIN gstat g USING (attr, con) WHERE p.n > 1 AND m.value <> p.center),
cand AS (SELECT * FROM (SELECT c.*, coalesce(s.sim, 0) AS sim FROM cand0 c {SIM0.format('c')}) WHERE sim < intra_ave_sim OR sim < ave_sim),
gone AS (SELECT {G}, cluster_id, value, center, sim FROM cand WHERE {rule('v1', 'v2')} = 'no'),
early0 AS (SELECT {G}, CAST(cluster_id AS VARCHAR) AS id1, 'v:' || value AS id2, least(value, center) AS v1, greatest(value, center) AS v2
  FROM (SELECT p.*, max(cluster_id) OVER (PARTITION BY attr, con) AS last FROM prof p) p JOIN (SELECT DISTINCT {G}, value FROM gone) g USING (attr, con) WHERE cluster_id < last AND value <> center),
doubt AS (SELECT x.* FROM (SELECT {G}, CAST(c1 AS VARCHAR) AS id1, CAST(c2 AS VARCHAR) AS id2, v1, v2, sim FROM cpair UNION ALL SELECT e.*, s.sim FROM early0 e JOIN sims s USING (attr, con, v1, v2)) x
  JOIN gstat g USING (attr, con) WHERE x.sim > g.intra_ave_sim),
unite AS (SELECT {G}, id1 AS v1, id2 AS v2 FROM doubt WHERE {rule('v1', 'v2')} = 'yes')""",
    comps("unite", "united"),
    f"""
nodes AS (SELECT {G}, CAST(cluster_id AS VARCHAR) AS node, value FROM mem ANTI JOIN gone USING (attr, con, cluster_id, value) UNION SELECT {G}, 'v:' || value, value FROM gone),
merged AS (SELECT DISTINCT n.attr, n.con, n.value, coalesce(u.component, n.node) AS cluster FROM nodes n LEFT JOIN united u USING (attr, con, node)),
gold AS (SELECT {G}, cluster_name, value, CASE WHEN count(*) OVER (PARTITION BY attr, con, cluster_name) > 1 THEN 'cluster' ELSE 'single' END AS kind FROM (SELECT {G}, string_split(value, ' ')[-1] AS cluster_name, value FROM pvals)),
over_ AS (SELECT g.attr, g.con, g.cluster_name, m.cluster_id, count(*) AS n FROM gold g JOIN mem m USING (attr, con, value) GROUP BY ALL),
rt AS (SELECT {G}, cluster_name, row_number() OVER (PARTITION BY attr, con ORDER BY count(*) DESC, cluster_name) - 1 AS y_true FROM gold GROUP BY attr, con, cluster_name),
rp AS (SELECT {G}, cluster_id, row_number() OVER (PARTITION BY attr, con ORDER BY count(*) DESC, CAST(cluster_id AS VARCHAR)) - 1 AS y_pred FROM mem GROUP BY attr, con, cluster_id),
lab AS (SELECT g.attr, g.con, g.value, CAST(rt.y_true AS INTEGER) AS y_true, CAST(rp.y_pred AS INTEGER) AS y_pred FROM gold g JOIN rt USING (attr, con, cluster_name) JOIN mem m USING (attr, con, value) JOIN rp USING (attr, con, cluster_id)),
cont AS (SELECT *, sum(n) OVER (PARTITION BY attr, con, y_true) AS a, sum(n) OVER (PARTITION BY attr, con, y_pred) AS b, sum(n) OVER (PARTITION BY attr, con) AS total FROM (SELECT {G}, y_true, y_pred, count(*) AS n FROM lab GROUP BY ALL)),
cd AS (SELECT {G}, y_true, y_pred, CAST(n AS DOUBLE) AS n, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(total AS DOUBLE) AS t FROM cont),
sm AS (SELECT {G}, max(t) AS N, sum(n * n) AS nn, sum(n * a) AS aa, sum(n * b) AS bb, sum(-n / t * ln(a / t)) AS ht, sum(-n / t * ln(b / t)) AS hp, sum(-n / t * ln(n / b)) AS htp, sum(-n / t * ln(n / a)) AS hpt, sum(n / t * ln(n * t / (a * b))) AS mi FROM cd GROUP BY {G}),
hc AS (SELECT *, CASE WHEN ht > 1e-12 THEN 1 - htp / ht ELSE 1 END AS h, CASE WHEN hp > 1e-12 THEN 1 - hpt / hp ELSE 1 END AS c FROM sm),
vm AS (SELECT {G}, {r('h + 1e-9')} AS homogeneity, {r('c + 1e-9')} AS completeness, CASE WHEN h + c > 1e-12 THEN {r('2 * h * c / (h + c) + 1e-9')} ELSE 0 END AS v_measure FROM hc),
ari0 AS (SELECT {G}, (nn - N) / 2 AS i, ((aa - N) / 2) * ((bb - N) / 2) / (N * (N - 1) / 2) AS ex, ((aa - N) / 2 + (bb - N) / 2) / 2 AS mx FROM sm),
ari AS (SELECT {G}, CASE WHEN abs(mx - ex) > 1e-12 THEN {r('(i - ex) / (mx - ex) + 1e-9')} ELSE 1 END AS ari FROM ari0),
fmi AS (SELECT {G}, CASE WHEN bb > N AND aa > N THEN {r('(nn - N) / sqrt((bb - N) * (aa - N))')} ELSE 0 END AS fmi FROM sm),
nmi AS (SELECT {G}, CASE WHEN (ht + hp) / 2 > 1e-12 THEN {r('mi / ((ht + hp) / 2) + 1e-9')} ELSE 1 END AS nmi FROM sm),
pur AS (SELECT {G}, {r('sum(n) / CAST(max(total) AS DOUBLE)')} AS purity FROM (SELECT {G}, y_pred, max(n) AS n, max(total) AS total FROM cont GROUP BY {G}, y_pred) GROUP BY {G}),
gs AS (SELECT {G}, cluster_name, count(*) AS gn FROM gold GROUP BY ALL),
ps AS (SELECT {G}, cluster_id, count(*) AS pn FROM mem GROUP BY ALL),
o AS (SELECT * FROM over_ JOIN gs USING (attr, con, cluster_name) JOIN ps USING (attr, con, cluster_id)),
op AS (SELECT {G}, sum(x) AS p_in, sum(same) AS p_same, sum(best) AS p_best FROM (SELECT {G}, cluster_id, max(CAST(n = pn AS INT)) AS x, max(CAST(n = pn AND n = gn AS INT)) AS same, max(n) AS best FROM o GROUP BY {G}, cluster_id) GROUP BY {G}),
og AS (SELECT {G}, sum(x) AS g_in, sum(same) AS g_same, sum(best) AS g_best FROM (SELECT {G}, cluster_name, max(CAST(n = gn AS INT)) AS x, max(CAST(n = pn AND n = gn AS INT)) AS same, max(n) AS best FROM o GROUP BY {G}, cluster_name) GROUP BY {G}),
cc AS (SELECT * FROM (SELECT {G}, count(*) AS n_gold, sum(gn) AS n_values FROM gs GROUP BY {G}) JOIN (SELECT {G}, count(*) AS n_pred FROM ps GROUP BY {G}) USING (attr, con) JOIN op USING (attr, con) JOIN og USING (attr, con)),
gpair AS (SELECT a.attr, a.con, a.value AS v1, b.value AS v2 FROM gold a JOIN gold b ON a.attr = b.attr AND a.con = b.con AND a.cluster_name = b.cluster_name AND a.value < b.value WHERE a.kind = 'cluster'),
pcount AS (SELECT {G}, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p) AS n_pred, count(*) FILTER (g) AS n_gold FROM (SELECT {G}, v1, v2, bool_or(g) AS g, bool_or(p) AS p FROM (SELECT {G}, v1, v2, true AS g, false AS p FROM gpair UNION ALL SELECT {G}, v1, v2, false, true FROM mp0) GROUP BY ALL) GROUP BY {G})""",
])


def prf(name: str, src: str, rp: str, op: str, rr: str, orr: str) -> str:
    p, q = (f"CASE WHEN {b} > 0 THEN {r(f'CAST({a} AS DOUBLE) / {b}')} ELSE 0 END" for a, b in ((rp, op), (rr, orr)))
    return f"SELECT {G}, p AS {name}_p, q AS {name}_r, CASE WHEN p + q > 0 THEN {r('2 * p * q / (p + q)')} ELSE 0 END AS {name}_f1 FROM (SELECT {G}, {p} AS p, {q} AS q FROM {src})"


PAIR = prf("pair", "pcount", "tp", "n_pred", "tp", "n_gold")
MACRO = prf("macro", "cc", "p_in", "n_pred", "g_in", "n_gold")
MICRO = prf("micro", "cc", "p_best", "n_values", "g_best", "n_values")
EXACT = prf("exact", "cc", "p_same", "n_pred", "g_same", "n_gold")


def _parse(col: str) -> str:
    t = f"string_split(string_split(lower({col}), 'output')[-1], '输出')[-1]"
    t = f"CASE WHEN starts_with({t}, '：') OR starts_with({t}, ':') THEN regexp_replace(substr({t}, 2), '^\\s+|\\s+$', '', 'g') ELSE {t} END"
    rules = " ".join("WHEN regexp_matches(t, '{}') THEN '{}'".format(a.replace("'", "''"), b) for a, b in ANSWER_RULES)
    return f"SELECT conv_id, turn, CASE WHEN {col} IS NULL OR lower({col}) = '{CALL_FAILED}' THEN 'failure' {rules} ELSE 'unknow' END AS answer FROM (SELECT *, {t} AS t FROM conversations)"


def statements() -> dict[str, str]:
    every = {
        "gold_values": f"SELECT DISTINCT {G}, value FROM gold",
        "embeddings_scan": f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, {r('list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))')} AS norm2 FROM embeddings",
        "value_freq": "SELECT * FROM vals",
        "sim_roundtrip": "SELECT * FROM sims",
        "target_values": f"SELECT DISTINCT {G}, value FROM gold WHERE attr || '_' || con IN ('p_name_ECONOMY', 'p_name_PROMO')",
        "strip_suffix": f"SELECT c_custkey, string_split(c_name || '{SUFFIX}' || c_mktsegment, '{SUFFIX}')[1] AS value FROM customer",
        "target_filter": "SELECT * FROM vals WHERE attr IN ('o_orderpriority')",
        "sim_threshold_edges": "SELECT * FROM links",
        "verdict_class": f"SELECT {G}, v1, v2, CASE WHEN raw IN ('no', 'unknow') THEN 'no' WHEN raw = 'yes' THEN 'yes' ELSE 'neither' END AS verdict FROM asked",
        "trivial_yes": "SELECT 'n_name' AS attr, r_name AS con, a.n_name AS v1, lower(b.n_name) AS v2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON r_regionkey = a.n_regionkey WHERE lower(a.n_name) = lower(b.n_name)",
        "char_pieces_w_freq": "SELECT * FROM cp",
        "char_piece_counts": f"SELECT {G}, piece, CAST(sum(cnt) AS BIGINT) AS cnt FROM cp GROUP BY ALL",
        "char_pieces_wo_freq": "SELECT * FROM cpo",
        "word_pieces": "SELECT * FROM wp",
        "word_contains": "SELECT * FROM within",
        "strip_numbers": f"SELECT conv_id, turn, regexp_replace(text, '{NUMBER}', '', 'g') AS value FROM conversations",
        "script_filter": r"SELECT doc_id, regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x20-\x7F]') AS has_script FROM documents",
        "prompt_build": f"SELECT {G}, v1, v2, b AS pair, b || chr(10) AS topk, b || chr(10) || 'Output:' AS early, b || chr(10) || 'Output:' AS review FROM (SELECT *, {TEMPLATE} || v1 || chr(10) || v2 AS b FROM sims)",
        "parse_answer": _parse("text"),
        "parse_answer_llama": f"SELECT {G}, v1, v2, CASE WHEN raw IN ('yes', 'no') THEN raw ELSE 'unsure' END AS answer FROM asked",
        "tf": "SELECT * FROM tf",
        "weighted_df": "SELECT * FROM wdf",
        "idf": "SELECT * FROM idf",
        "tfidf": "SELECT * FROM tfidf",
        "idf_vector": "SELECT * FROM idfv",
        "all_pairs": "SELECT * FROM pairs",
        "shared_piece_pairs": "SELECT a.attr, a.con, a.value AS v1, b.value AS v2, CAST(sum(a.cnt) AS BIGINT) AS shared FROM cp a JOIN cp b ON a.attr = b.attr AND a.con = b.con AND a.piece = b.piece AND a.value < b.value GROUP BY ALL",
        "wjaccard_w_freq": "SELECT * FROM sims",
        "wjaccard_wo_freq": "SELECT * FROM simso",
        "tfidf_cosine_pairs": "SELECT * FROM tcos",
        "idf_cosine_pairs": "SELECT * FROM icos",
        "cosine_pairs": "SELECT * FROM ecos",
        "cosine_for_pairs": f"SELECT e.* FROM ecos e JOIN (SELECT {G}, min(value) AS v1 FROM emb GROUP BY ALL) m USING (attr, con, v1)",
        "blended_sims": f"SELECT a.attr, a.con, a.v1, a.v2, {r('CAST(0.6 AS DOUBLE) * a.sim + (1 - CAST(0.6 AS DOUBLE)) * b.sim')} AS sim FROM sims a JOIN tcos b USING (attr, con, v1, v2)",
        "pair_lookup_default0": "SELECT p.attr, p.con, p.v2 AS v1, p.v1 AS v2, coalesce(s.sim, 0) AS sim FROM pairs p LEFT JOIN sims s USING (attr, con, v1, v2)",
        "sim_extent": f"SELECT {G}, min(sim) AS min_sim, max(sim) AS max_sim, {r('(min(sim) + max(sim)) / 2')} AS mid_sim FROM sims GROUP BY ALL",
        "sim_saturated": "SELECT * FROM ecos WHERE sim >= 1 UNION ALL SELECT * FROM tcos WHERE sim >= 1",
        "center_pairs": "SELECT * FROM cpair",
        "hac_single_link": "SELECT v.attr, v.con, v.value, coalesce(h.component, v.value) AS cluster FROM pvals v LEFT JOIN hac h ON v.attr = h.attr AND v.con = h.con AND v.value = h.node",
        "transitive_closure": "SELECT v.attr, v.con, v.value, coalesce(h.component, v.value) AS cluster FROM pvals v LEFT JOIN closed h ON v.attr = h.attr AND v.con = h.con AND v.value = h.node",
        "star_clusters": f"SELECT {G}, v1 AS cluster, v1 AS value FROM yes UNION SELECT {G}, v1, v2 FROM yes UNION SELECT {G}, value, value FROM (SELECT {G}, value FROM pvals EXCEPT (SELECT {G}, v1 FROM yes UNION SELECT {G}, v2 FROM yes))",
        "pair_clusters": f"SELECT {G}, v1, v2 FROM yes UNION SELECT {G}, value, NULL FROM (SELECT {G}, value FROM pvals EXCEPT (SELECT {G}, v1 FROM yes UNION SELECT {G}, v2 FROM yes))",
        "unclustered_singletons": f"SELECT {G}, value FROM pvals EXCEPT (SELECT {G}, v1 FROM yes UNION SELECT {G}, v2 FROM yes)",
        "dbscan_eps": "SELECT v.attr, v.con, v.value, h.component AS cluster FROM emb v LEFT JOIN dense h ON v.attr = h.attr AND v.con = h.con AND v.value = h.node",
        "modularity": f"""SELECT {G}, {r('sum(l / m - (d / (2 * m)) ** 2) + 1e-9')} AS modularity FROM
            (SELECT {G}, c, sum(sim) AS d, sum(inner_) AS l FROM (SELECT {G}, ascii(v1) AS c, sim, CASE WHEN ascii(v1) = ascii(v2) THEN sim ELSE 0 END AS inner_ FROM sims UNION ALL SELECT {G}, ascii(v2), sim, 0 FROM sims) GROUP BY ALL)
            JOIN (SELECT {G}, sum(sim) AS m FROM sims GROUP BY ALL) USING (attr, con) GROUP BY {G}""",
        "ranked_pairs": "SELECT * FROM ranked",
        "topk_pairs": "SELECT * FROM ranked WHERE rank <= 200",
        "early_stop_pairs": f"""SELECT {G}, v1, v2, sim, rank, answer FROM (SELECT *, min(CASE WHEN answer = 'no' AND run >= 5 THEN rank END) OVER (PARTITION BY attr, con) AS stop_ FROM
            (SELECT *, sum(CAST(answer = 'no' AS INT)) OVER (PARTITION BY attr, con, island ORDER BY rank) AS run FROM
            (SELECT *, sum(CAST(answer = 'yes' AS INT)) OVER (PARTITION BY attr, con ORDER BY rank) AS island FROM (SELECT *, {rule('v1', 'v2')} AS answer FROM ranked)))) WHERE stop_ IS NULL OR rank <= stop_""",
        "verdict_hits": "SELECT k.*, v.answer FROM keyed k JOIN verdicts v USING (attr, con, k1, k2)",
        "verdict_misses": "SELECT * FROM missed",
        "budgeted_misses": "SELECT *, row_number() OVER (PARTITION BY attr, con ORDER BY v1, v2) AS rank FROM missed QUALIFY rank <= 100",
        "stratified_cap": f"""SELECT {G}, cluster_id, v1, v2 FROM (SELECT *, count(*) OVER (PARTITION BY attr, con) AS total, count(*) OVER (PARTITION BY attr, con, cluster_id) AS n, row_number() OVER (PARTITION BY attr, con, cluster_id ORDER BY v1, v2) AS rank
            FROM (SELECT {G}, ascii(v1) AS cluster_id, v1, v2 FROM sims)) WHERE total <= 500 OR rank <= floor(500 * n / total)""",
        "cost_report": f"SELECT {G}, count(*) AS needed, count(*) FILTER (source = 'new') AS calls, CAST(coalesce(sum(length(prompt)) FILTER (source = 'new'), 0) AS BIGINT) AS sent, CAST(coalesce(sum(length(raw)) FILTER (source = 'new'), 0) AS BIGINT) AS received FROM asked GROUP BY ALL",
        "cluster_medoid": f"SELECT {G}, cluster_id, center FROM prof",
        "cluster_profile": "SELECT * FROM prof",
        "group_sim_stats": "SELECT * FROM gstat",
        "intra_candidates": f"SELECT {G}, cluster_id, value, center, sim FROM cand",
        "evicted_members": "SELECT * FROM gone",
        "inter_candidates": "SELECT * FROM doubt",
        "merged_clusters": "SELECT * FROM merged",
        "corrected_clusters": "SELECT * FROM merged",
        "gold_pred_overlap": "SELECT * FROM over_",
        "label_vectors": "SELECT * FROM lab",
        "pair_prf": "SELECT * FROM pcount",
        "eval_pair_f1": PAIR,
        "eval_macro_f1": MACRO,
        "eval_micro_f1": MICRO,
        "eval_exact_f1": EXACT,
        "eval_fmi": "SELECT * FROM fmi",
        "eval_vmeasure": "SELECT * FROM vm",
        "eval_ari": "SELECT * FROM ari",
        "eval_nmi": "SELECT * FROM nmi",
        "eval_acc": f"SELECT {G}, {r('avg(CAST(y_true = y_pred AS DOUBLE))')} AS acc FROM lab GROUP BY ALL",
        "eval_purity": "SELECT * FROM pur",
        "eval_purity_compat": f"SELECT {G}, {r('sum(n) / CAST(max(total) AS DOUBLE)')} AS purity FROM (SELECT {G}, y_pred, max(n) AS n, max(total) AS total FROM cont c WHERE EXISTS (SELECT 1 FROM lab l WHERE l.attr = c.attr AND l.con = c.con AND l.y_true = c.y_pred) GROUP BY {G}, y_pred) GROUP BY {G}",
        "eval_report": f"SELECT * FROM ({PAIR}) JOIN ({MACRO}) USING (attr, con) JOIN ({MICRO}) USING (attr, con) JOIN ({EXACT}) USING (attr, con) JOIN pur USING (attr, con) JOIN ari USING (attr, con) JOIN fmi USING (attr, con) JOIN nmi USING (attr, con) JOIN vm USING (attr, con)",
    }
    return {k: f"WITH RECURSIVE {CTES}\n{v}" for k, v in every.items()}
