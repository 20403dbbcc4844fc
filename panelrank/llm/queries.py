"""The registered query of every operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrank.llm import bpe, decontaminate, fingerprints, forest, lines, manifest, pii, quality, search, simhash, suffixes, toxicity, urls
from panelrank.llm.common import fold_column, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold_column("doc_id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = quality.word_vectors(docs)
    net = quality.fit(*quality.training_rows(docs, labels, "quality", vectors))
    return _judged(quality.score(docs, vectors, net), 0.3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.judged(table(spark, sf_dir, "documents"), exact=1)
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        "n_links",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), cut AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
  FROM item WHERE len(w) > 0
), b AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM cut
), spot AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n
), place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM spot
), hit AS (
  SELECT r, i, n, item_id FROM place JOIN b USING (n, g)
), word AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP7_SQL = f"""
WITH RECURSIVE page AS (
  SELECT row_number() OVER () AS r, page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_ASCII_LOWER}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}
), fit AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM page JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path)
  GROUP BY r
), judged AS (
  SELECT * FROM page LEFT JOIN fit USING (r)
), link AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT DISTINCT r, host AS src, translate(unnest(regexp_extract_all(html,
      '(?i)\\b(?:href|src)\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#"''\\s<>]+)', 1)),
      {_ASCII_LOWER}) AS dst FROM page)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), seed AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t0,
    avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d0
  FROM judged WHERE host <> '' GROUP BY host
  UNION ALL
  SELECT DISTINCT dst, 0, 0 FROM link WHERE dst NOT IN (SELECT host FROM page)
), move AS (
  SELECT src AS h, dst AS g, n / sum(n) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM link
  UNION ALL
  SELECT dst, src, 0, n / sum(n) OVER (PARTITION BY dst) FROM link
), spread AS (
  SELECT 0 AS k, host, t0, d0, 0.15::DOUBLE * t0 AS t, 0.15::DOUBLE * d0 AS d FROM seed
  UNION ALL
  SELECT k + 1, host, t0, d0, 0.15::DOUBLE * t0 + 0.85::DOUBLE * coalesce(mt, 0),
    0.15::DOUBLE * d0 + 0.85::DOUBLE * coalesce(md, 0)
  FROM spread LEFT JOIN (
    SELECT g, sum(move.t * s.t) AS mt, sum(move.d * s.d) AS md
    FROM move JOIN spread s ON s.host = h GROUP BY g) ON g = host
  WHERE k < 130
)
SELECT page_id, judged.host, path, rule,
  coalesce(verdict, CASE WHEN d - t > 0.5 * (1 - 0.85) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN (SELECT host, t, d FROM spread WHERE k = 130) s USING (host)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.sample(docs, labels, "toxic"))
    return _judged(toxicity.score(docs, model), 0.5)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(VOCABULARY),
        public_tokenizers.PATTERN,
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(pii.sample(docs)))

    def listed(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.concat_ws(",", named)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    order = F.array(*[F.lit(k) for k in pii.KINDS])
    keyed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(
            F.array_position(order, s["kind"]).alias("place"), s["start"], s["end"], s["kind"]
        ),
    )
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(keyed)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id"
    )


_TERMS = _WORDS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
OP11_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), size AS (
  SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0
), item AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), post AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM post, size GROUP BY term
), impact AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))) AS i
  FROM post JOIN weight USING (term), size
), scored AS (
  SELECT item_id, r, doc_id, sum(i)::BIGINT AS score FROM impact JOIN item USING (term)
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    found = manifest.manifest(
        table(spark, sf_dir, "documents"),
        "doc_id",
        "lang",
        FIELDS,
        keep={"tried": F.when(tampered, manifest.leaf(other))},
    )
    start = F.coalesce("tried", "leaf")
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        manifest.folded(start, F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _encoded(field: str) -> str:
    text = f"({field})::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


# Bits of the remainder one after the other: a number to mix in per byte, then eight shifts (-1).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels: (level, g, pos, digest, n), with n nodes of the group on the level."""
    return f"""{name}(level, g, pos, digest, n) AS (
  SELECT 0, g, pos, digest, n FROM {leaves}
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY level, g, pos // 2, n
)"""


def _walk_sql(name: str, start: str, tree: str) -> str:
    """Proof text and folded digest of every row of ``start``, one level at a time."""
    return f"""{name}(level, r, g, pos, h, proof) AS (
  SELECT 0, r, g, pos, h, proof FROM {start}
  UNION ALL
  SELECT w.level + 1, r, w.g, w.pos // 2,
    sha256(CASE WHEN w.pos % 2 = 0 THEN h || coalesce(s.digest, '') ELSE s.digest || h END),
    proof || coalesce(s.digest, '')
  FROM {name} w JOIN {tree} o ON o.level = w.level AND o.g = w.g AND o.pos = w.pos AND o.n > 1
  LEFT JOIN {tree} s ON s.level = w.level AND s.g = w.g AND s.pos = xor(w.pos, 1)
)"""


OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g,
    {_leaf_sql("n_chars")} AS digest,
    CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS tried
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n FROM docs
), {_tree_sql("tree", "leaves")}, subroots AS (
  SELECT g AS name, '' AS g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos,
    count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree_sql("crown", "subroots")}, lower_start AS (
  SELECT r, g, pos, coalesce(tried, digest) AS h, '' AS proof FROM leaves
), {_walk_sql("lower_walk", "lower_start", "tree")}, upper_start AS (
  SELECT r, subroots.g, subroots.pos, h, proof
  FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS last FROM lower_walk) w
  JOIN subroots ON subroots.name = w.g WHERE last = 1
), {_walk_sql("upper_walk", "upper_start", "crown")}
SELECT doc_id, leaves.digest AS leaf, subroots.digest AS subroot, root, sha256(proof) AS proof_sha256,
  h AS folded_root, h = root AS verified
FROM leaves JOIN subroots ON subroots.name = leaves.g
JOIN (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS last FROM upper_walk) w
  ON w.r = leaves.r AND last = 1
CROSS JOIN (SELECT digest AS root FROM crown WHERE n = 1)
"""


def op13_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_prefix_forest": op4_prefix_forest,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_personal_data": op10_personal_data,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_document_sketch": op13_document_sketch,
}
SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op7_url_filter": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
