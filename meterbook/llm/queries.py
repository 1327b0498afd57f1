"""The numbered queries and, where SQL can express one, its twin."""

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import bpe, decontaminate, fingerprint, language, licenses, neardup, phrases, quality, secrets, surrogates, warc, whitening
from .common import columns, prepare, staged, table
from .rollup import RollupStore

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Two versions of a word counter: runs of non-blanks; words and single other signs.
COUNTERS = {"blank-1": r"[^\x20\x09-\x0D]+", "sign-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]"}


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_root(prepare(spark)).rstrip('/')}/llm-{what}/{uuid.uuid4().hex}"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.reassemble(warc.read_records(spark, path))
    of_uri = lambda uri: F.try_element_at(F.split(uri, ":"), F.lit(3)).try_cast("long")
    stored = F.col("type") == "response"
    return found.select(
        of_uri(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, warc.base32_sha1(F.col("payload"))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        of_uri(F.col("refers_to")).alias("refers_to"),
    )


_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS h,
             max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT
    >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5
        THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with estimates, its correction, a second counter, withdrawals, and a replay."""
    prepare(spark)
    rows = columns(table(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", n_chars="long", text="string")
    counts = [F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(k) for k, p in COUNTERS.items()]
    known = staged(rows.select("doc_id", "source", "lang", (F.col("n_chars") / 6).cast("long").alias("guess"), *counts), "counts")
    first, second = COUNTERS

    def change(df: DataFrame, kind: str, tokenizer: str, tokens: str, old: str | None = None) -> DataFrame:
        before = F.col(f"`{old}`") if old else F.lit(None).cast("long")
        return df.select(F.lit(kind).alias("change"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
                         F.col(f"`{tokens}`").alias("tokens"), before.alias("old_tokens"))

    poor = columns(table(spark, sf_dir, "labels"), doc_id="long", quality="int").filter("quality = 0").select("doc_id").distinct()
    gone = known.join(poor, "doc_id", "left_semi")
    store = RollupStore(spark, _fresh(spark, "rollup"))
    store.commit("load", change(known, "insert", first, "guess"))
    store.commit("exact", change(known, "revise", first, first, "guess"))
    store.commit("second", change(known, "insert", second, second))
    store.commit("withdrawn", change(gone, "delete", first, first).union(change(gone, "delete", second, second)))
    store.commit("load", change(known, "insert", first, "guess"))
    return store.totals()


_OP5 = """
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents d
           WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)),
c AS (SELECT source, lang, 'blank-1' AS tokenizer, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM d
      UNION ALL SELECT source, lang, 'sign-2',
        len(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+|[^0-9A-Za-z\\x{80}-\\x{10FFFF}\\x20\\x09-\\x0D]')) FROM d)
SELECT source, lang, tokenizer, count(*) AS documents, sum(n)::BIGINT AS tokens FROM c GROUP BY ALL
"""


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.digest(F.col("items")).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _words(name: str) -> str:
    lower = f"translate(coalesce({name}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_OP7 = f"""
WITH b AS (SELECT item_id, {_words("benchmark")} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest([array_to_string(ws[i:i + 9], ' ')
        FOR i IN range(1, greatest(len(ws) - 9, 1) + 1)]) AS g FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, {_words("documents")} AS ws FROM documents),
k AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS pos, ws FROM d, k WHERE len(ws) >= m),
h AS (SELECT doc_id, pos, g.m, item_id FROM g JOIN p ON p.m = g.m AND p.g = array_to_string(ws[pos:pos + g.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n,
        array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_edits(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c), 256).alias(c)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", digest("fingerprint"), digest("edited_fingerprint"), "near_edited", "near_next"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    error = None if model is None else whitening.identity_error(vectors, model)
    return whitening.whiten(vectors, model).withColumn("identity_error", F.lit(error).cast("double"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


_OP12 = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, k, unnest([ws[i:i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS ws
      FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, ws, f AS a FROM f WHERE k >= 2 AND f >= 10),
s AS (SELECT c.*, x.f AS l, y.f AS r, x.k AS cut,
             (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.ws = c.ws[1:x.k]
             JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.ws = c.ws[x.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
o AS (SELECT lang, ws[1:2] AS ws, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2:3], a FROM c WHERE k = 3),
m AS (SELECT lang, ws, max(a) AS over FROM o GROUP BY ALL),
p AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN m USING (lang, ws)
      WHERE over IS NULL OR 100 * over < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM p)
SELECT t.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs, language.ORDER))
    held_out = language.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "entropy", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_near_duplicates, op3_secrets, op4_licenses, op5_token_rollup,
        op6_surrogates, op7_decontamination, op8_fingerprints, op9_quality, op10_bpe,
        op11_whitening, op12_collocations, op13_language_id,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_warc": _OP1, "op2_near_duplicates": _OP2, "op5_token_rollup": _OP5, "op7_decontamination": _OP7, "op12_collocations": _OP12}
