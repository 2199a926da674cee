"""The pipeline operators bound to the given tables, each next to the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.llm import (
    common, exact, fingerprints, lexical, licenses, lmscore, manifest, mixing, neardup, packing, quality, substrings, tokenfiles, toxicity)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.tune(spark)
            return function(spark, sf_dir)
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query()
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times")


@query(sql="""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


#: Documents in this remainder are held out from learning.
HELD_OUT_SQL = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"


def fit_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", label).where(f"NOT ({HELD_OUT_SQL})")


def predicted(scored: DataFrame, threshold: float) -> DataFrame:
    score = F.col("score")
    return scored.select("doc_id", F.expr(HELD_OUT_SQL).alias("held_out"), "score", (score >= threshold).cast("int").alias("predicted"))


@query()
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048).drop("text_hash")


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokenfiles.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = toxicity.fit_field(docs, fit_labels(spark, sf_dir, "toxic"))
    return predicted(toxicity.score(docs, field), 0.3)


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return predicted(quality.score(docs, fit_labels(spark, sf_dir, "quality")), 0.7)


@query(sql="""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"), similarity=0.85)


@query(sql="""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS label
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
repeated AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY label) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM repeated, range(50) AS r(o)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.pos) FILTER (WHERE gone.pos IS NULL) AS text, count(gone.pos) AS n_removed
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.pos = gone.pos GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=50)
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(sql="""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, unnest(list_prepend(NULL, words[:-2])) AS before FROM w WHERE len(words) > 0),
ones AS (SELECT word, count(*) AS c FROM each GROUP BY 1),
twos AS (SELECT before, word, count(*) AS c FROM each WHERE before IS NOT NULL GROUP BY 1, 2),
total AS (SELECT sum(c) AS n FROM ones),
scored AS (SELECT each.doc_id, CASE WHEN each.before IS NULL THEN ln(w1.c / n) WHEN t.c >= 2 THEN ln(t.c / v.c) ELSE ln(0.4::DOUBLE * w1.c / n) END AS gain
  FROM each CROSS JOIN total JOIN ones w1 ON w1.word = each.word LEFT JOIN ones v ON v.word = each.before
  LEFT JOIN twos t ON t.before = each.before AND t.word = each.word)
SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score
FROM w LEFT JOIN (SELECT doc_id, sum(gain) AS s FROM scored GROUP BY 1) USING (doc_id)""")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return scored.withColumn("log_score", F.round("log_score", 4))


@query(sql="""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, unnest(list_prepend(NULL, words[:-2])) AS before,
  unnest(list_prepend(NULL, list_prepend(NULL, words[:-3]))[:len(words)]) AS earlier FROM w WHERE len(words) > 0),
ones AS (SELECT word, count(*) AS c FROM each GROUP BY 1),
twos AS (SELECT before, word, count(*) AS c FROM each WHERE before IS NOT NULL GROUP BY 1, 2),
threes AS (SELECT earlier, before, word, count(*) AS c FROM each WHERE earlier IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT sum(c) AS n FROM ones),
scored AS (SELECT each.doc_id, CASE WHEN r.c >= 2 THEN ln(r.c / u.c)
    WHEN t.c >= 2 THEN ln((CASE WHEN each.earlier IS NULL THEN 1 ELSE 0.4::DOUBLE END) * t.c / v.c)
    ELSE ln((CASE WHEN each.before IS NULL THEN 1 WHEN each.earlier IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4::DOUBLE END) * w1.c / n) END AS gain
  FROM each CROSS JOIN total JOIN ones w1 ON w1.word = each.word LEFT JOIN ones v ON v.word = each.before
  LEFT JOIN twos t ON t.before = each.before AND t.word = each.word
  LEFT JOIN twos u ON u.before = each.earlier AND u.word = each.before
  LEFT JOIN threes r ON r.earlier = each.earlier AND r.before = each.before AND r.word = each.word)
SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score
FROM w LEFT JOIN (SELECT doc_id, sum(gain) AS s FROM scored GROUP BY 1) USING (doc_id)""")
def op3_lm_score_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), order=3)
    return scored.withColumn("log_score", F.round("log_score", 4))


#: Unsigned crc32 of a text of ASCII digits, bit by bit: DuckDB has no such function.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""


def manifest_sql(levels: int = 6, source_levels: int = 4) -> str:
    """The contract of op12 for sources of up to 16 ** ``levels`` rows and up to 16 ** ``source_levels`` sources."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, count: int) -> str:
        """Levels of nodes (t, i, d, n), a tree's last node staying as it is."""
        step = """{0}{2} AS (SELECT t, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (n + 15) // 16 AS n
  FROM {0}{1} GROUP BY t, i // 16, n)"""
        return ",\n".join(step.format(name, k, k + 1) for k in range(count))

    def climb(name: str, count: int, start: str) -> str:
        """Up from the leaves: the digests beside the own one, and the folded digest."""
        step = """{0}c{2} AS (SELECT c.doc_id, c.t, c.i // 16 AS i, c.proof || coalesce(o.l, '') || coalesce(o.r, '') AS proof,
  CASE WHEN o.n > 1 THEN sha256(coalesce(o.l, '') || c.f || coalesce(o.r, '')) ELSE c.f END AS f
  FROM {0}c{1} c JOIN {0}o{1} o ON c.t = o.t AND c.i = o.i)"""
        beside = """{0}o{1} AS (SELECT t, i, n, string_agg(d, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  string_agg(d, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {0}{1})"""
        return f"{name}c0 AS ({start}),\n" + ",\n".join(f"{beside.format(name, k)},\n{step.format(name, k, k + 1)}" for k in range(count))

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = CRC32_SQL.format("doc_id::VARCHAR")
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, {leaf('text')} AS d,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS altered FROM documents),
a0 AS (SELECT t, i, d, n FROM leaves),
{tree('a', levels)},
b0 AS (SELECT 0 AS t, t AS i, d, (SELECT count(*) FROM a{levels}) AS n FROM a{levels}),
{tree('b', source_levels)},
{climb('a', levels, "SELECT doc_id, t, i, '' AS proof, altered AS f FROM leaves")},
{climb('b', source_levels, f"SELECT doc_id, 0 AS t, t AS i, proof, f FROM ac{levels}")}
SELECT doc_id, leaves.d AS leaf, a{levels}.d AS subroot, b{source_levels}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{source_levels}.d AS verified
FROM bc{source_levels} JOIN leaves USING (doc_id) JOIN a{levels} ON a{levels}.t = leaves.t CROSS JOIN b{source_levels}"""


@query(sql=manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *manifest.FIELDS)
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    chosen = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0")
    proved = manifest.proofs(docs, altered={"text": F.when(chosen, lowered).otherwise(F.col("text"))})
    root = manifest.folded(F.col("altered_leaf"), F.col("path"))
    return proved.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
                         root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def licenses_sql() -> str:
    given = [(label, text, "true") for label, text in licenses.PHRASES.items()] + [(label, text, "false") for label, text in licenses.TEMPLATES]
    values = ", ".join(f"({i}, '{label}', '{text}', {base})" for i, (label, text, base) in enumerate(given))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT template, label, base, string_split(phrase, ' ') AS words FROM (VALUES {values}) AS v(template, label, phrase, base)),
known AS (SELECT template, label, base, len(words) - 1 AS n, i - 1 AS place, words[i] || ' ' || words[i + 1] AS run
  FROM (SELECT *, unnest(generate_series(1, len(words) - 1)) AS i FROM t)),
runs AS (SELECT doc_id, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS run FROM (SELECT *, unnest(generate_series(1, len(words) - 1)) AS i FROM w)),
votes AS (SELECT doc_id, template, label, base, n, pos - place AS diagonal, list(place) AS places, min(pos) AS first FROM runs JOIN known USING (run) GROUP BY ALL),
merged AS (SELECT a.doc_id, a.template, a.label, a.base, a.n, a.diagonal, min(b.first) AS first, len(list_distinct(flatten(list(b.places)))) AS held
  FROM votes a JOIN votes b ON a.doc_id = b.doc_id AND a.template = b.template
    AND b.diagonal BETWEEN a.diagonal AND a.diagonal + CASE WHEN a.base THEN 0 ELSE {licenses.SLACK} END GROUP BY ALL),
hits AS (SELECT * FROM merged WHERE CASE WHEN base THEN held = n ELSE held >= n * {licenses.LEAST_SHARE} END)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(held::DOUBLE / n) AS score FROM hits GROUP BY 1) USING (doc_id)"""


@query(sql=licenses_sql())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("spans")


@query(sql="""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, sum(len(terms)) AS total FROM docs WHERE len(terms) > 0),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held CROSS JOIN corpus GROUP BY 1),
lengths AS (SELECT doc_id, (25 + (75 * len(terms)::HUGEINT * n) // total)::BIGINT AS m FROM docs CROSS JOIN corpus WHERE len(terms) > 0),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
