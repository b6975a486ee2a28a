"""The registered queries of this subpackage, one per operator, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, lang_id, latent, mixing, ngram_join, prefix_trie, repeats, spelling, token_counts, toxicity, warc
from termweave.llm import host_rules as HR
from termweave.llm import rule_ensemble as RE
from termweave.llm.common import remainder, written
from termweave.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its own name."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _host_rules_sql() -> str:
    """The counts, the host rates with their beta prior, and the verdicts, as DuckDB states them."""
    measure = {r.name: r.measure for r in HR.RULES}
    strict = ", ".join(f"sum(CASE WHEN {measure[r.name]} > {r.strict} THEN 1 ELSE 0 END) AS f_{r.name}" for r in HR.RULES)
    rates = []
    for r in HR.RULES:
        x = f"f_{r.name}"
        mean = f"((sum({x}) OVER () + 0.5) / (sum(n) OVER () + 1.0))"
        spread = f"(avg(pow({x} / n, 2)) OVER () - pow(avg({x} / n) OVER (), 2))"
        between = f"greatest({spread} - {mean} * (1 - {mean}) * avg(1.0 / n) OVER (), {mean} * (1 - {mean}) * 1e-3)"
        weight = f"greatest({mean} * (1 - {mean}) / {between} - 1, 2.0)"
        rates.append(f"({x} + {mean} * {weight}) / (n + {weight}) > {HR.SUSPECT_RATE} AS s_{r.name}")
    passes = " AND ".join(f"NOT ({measure[r.name]} > {r.loose} OR ({measure[r.name]} > {r.strict} AND s_{r.name}))" for r in HR.RULES)
    return rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
              SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, coalesce('s' || source, 'n') AS host, len(words) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (doc_id)),
hosts AS (SELECT host, count(*) AS n, {strict} FROM counts GROUP BY host),
verdicts AS (SELECT host, {", ".join(rates)} FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {passes} AS kept
FROM counts JOIN verdicts USING (host)
"""


@query(_host_rules_sql())
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    docs = table(spark, sf_dir, "documents")
    judged, rules = HR.host_rules(docs, keep=["doc_id"])
    return judged.select("doc_id", *[F.col(f"{rules}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the sentence-piece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = docs.select("doc_id", bpe.encoded(F.col("text"), *ranks).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decoded(F.col("ids"), *ranks).alias("back"))
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("back"), 256).alias("decoded_sha256"),
    )


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE bodies AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS tokens
  FROM bodies),
posted AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posted a JOIN posted b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(u, v) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u)
SELECT doc_id, len(tokens) AS n_shingles, (SELECT min(v) FROM reached WHERE u = doc_id) AS component_id FROM sets
""")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 4-word shingles, Jaccard similarity of 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    options = ngram_join.JoinOptions(words=4, percent=85)
    return ngram_join.similar(docs, options=options).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query(r"""
WITH bodies AS (SELECT doc_id, encode(coalesce(text, '')) AS body, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, body, unnest(range(1, n - 198)) AS s FROM bodies WHERE n >= 200),
named AS (SELECT doc_id, s, md5(hex(body[s:s + 199])) AS name FROM starts),
again AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM named) WHERE c > 1),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS opens FROM again),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
spans AS (SELECT doc_id, g, min(s) AS first, max(s) + 200 AS next FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(next) OVER (PARTITION BY doc_id ORDER BY g), 1) AS a, first AS b FROM spans
  UNION ALL SELECT doc_id, max(next), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(body[a:coalesce(b, n + 1) - 1]), '' ORDER BY a) AS kept FROM gaps JOIN bodies USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(next - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN kept IS NULL THEN body ELSE unhex(kept) END) AS kept_sha256
FROM bodies LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
""")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated 200-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done, into = repeats.without_repeats(docs, length=200)
    return done.select("doc_id", *[F.col(f"{into}.{c}") for c in ("n_bytes", "n_removed", "n_spans")], F.sha2(F.col(f"{into}.kept"), 256).alias("kept_sha256"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 5)
    trees = lang_id.fit(docs.filter(fold != 0))
    found = docs.select("doc_id", (fold == 0).alias("held_out"), lang_id.language(F.col("text"), trees).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from two folds of three."""
    measured = written(RE.statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "op3-statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    fold = remainder("doc_id", 3)
    ensemble = RE.fit(measured.filter(fold != 1).join(labels, "doc_id"))
    scored = measured.select("doc_id", (fold == 1).alias("held_out"), RE.compiled(ensemble).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: SHA-1 in base 32: forty bits of the hexadecimal digest give eight digits.
_BASE32_SQL = (
    f"array_to_string(list_transform(range(32), lambda k: substr('{warc.BASE32}', 1 + (((('0x' || substr(h, 1 + 10 * (k // 8), 10))::UBIGINT "
    ">> (35 - 5 * (k % 8))) & 31)::INT), 1)), '')"
)


@query(f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM payloads)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts
""")
def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, read back from the archives written for them."""
    found = warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document leaks, verbatim or paraphrased."""
    found = latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("common").alias("common_words"), F.col("words").alias("item_words"), F.round("cosine", 4).alias("cosine"))


def _mixing_sql(mix: mixing.Mix) -> str:
    """Sizes, weights and keys as DuckDB states them; the level is found among the sources in order of size per weight."""
    shares = ", ".join(f"{s}::DOUBLE" for s in mix.shares)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         greatest(length(translate(coalesce(text, ''), '{mixing.UNUSUAL}', '')) / greatest(length(coalesce(text, '')), 1)::DOUBLE, {mixing.LEAST_WEIGHT}) AS weight
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE) / weight AS key FROM sized),
sources AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [{shares}][1 + place % {len(mix.shares)}] AS w FROM sources),
ranked AS (
  SELECT *, ({mix.volume}::DOUBLE * sum(s) OVER () - {mix.most} * coalesce(sum(s) OVER before, 0)) / sum(w) OVER rest AS level
  FROM weighed WINDOW before AS (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      rest AS (ORDER BY s / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
levels AS (SELECT min_by(level, s / w) AS level FROM ranked WHERE w * level <= {mix.most} * s),
goals AS (SELECT source, s::BIGINT AS source_size, least({mix.most} * s, w * coalesce((SELECT level FROM levels), 0)) AS target FROM weighed),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
along AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, floor(g.target) - g.epochs * g.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id::VARCHAR, k.size ROWS UNBOUNDED PRECEDING) - k.size AS start
  FROM keyed k JOIN plan g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(least(size, rest - start), 0))::BIGINT AS taken FROM along
"""


@query(_mixing_sql(mixing.Mix()))
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: weights 5, 2, 1, one and a half times all words, two epochs at most."""
    docs = table(spark, sf_dir, "documents")
    rows, into = mixing.mixed(docs, mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text")), keep=["doc_id"])
    return rows.select("doc_id", *[F.col(f"{into}.{c}") for c in ("size", "source_size", "target", "taken")])


#: CRC-32 by its polynomial: the table from its rule, then one step per byte of a list of byte values.
_CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"


def _crc32_sql(octets: str, lookup: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {lookup}[1 + (xor(c, b) & 255)])), 4294967295)"


@query(f"""
WITH lookup AS (SELECT {_CRC_TABLE_SQL} AS t),
ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS p, {_crc32_sql("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)", "t")} % 9 AS h
          FROM (SELECT DISTINCT c FROM ordered), lookup),
shared AS (SELECT v.c, o.pos, o.role, o.text FROM convs v JOIN ordered o ON o.c = v.p AND o.pos <= v.h),
counted AS (SELECT v.c, v.h, count(s.pos) AS k FROM convs v LEFT JOIN shared s ON s.c = v.c GROUP BY v.c, v.h),
rebuilt AS (SELECT * FROM shared UNION ALL SELECT o.c, k.k + o.pos - k.h, o.role, o.text FROM ordered o JOIN counted k ON o.c = k.c AND o.pos > k.h),
prefixes AS (SELECT c, pos AS depth, octet_length(encode(text)) AS bytes, list([role, text]) OVER (PARTITION BY c ORDER BY pos) AS path FROM rebuilt),
nodes AS (
  SELECT depth, path, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM prefixes GROUP BY depth, path
  UNION ALL SELECT 0, []::VARCHAR[][], min(c), count(*), 0 FROM convs HAVING count(*) > 0),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n - 1) * n.bytes AS saved FROM nodes n LEFT JOIN kids k USING (path)),
behind AS (
  SELECT path[1:d] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1),
tips AS (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c),
ends AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (
    SELECT p.c, p.path FROM prefixes p JOIN tips t ON p.c = t.c AND p.depth = t.depth
    UNION ALL SELECT c, []::VARCHAR[][] FROM convs WHERE c NOT IN (SELECT c FROM tips)) GROUP BY path)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM valued v JOIN behind b USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1]
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the head its group shares."""
    turns = written(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "op12-turns")
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


#: One code point in this many occurrences is lost, by the digest of document and run.
WEAR = 199


def _spelling_sql(options: spelling.Spelling) -> str:
    """Words by deletion and wildcard patterns in place of chunks."""
    octets = "list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::BIGINT)"
    return f"""
WITH RECURSIVE lookup AS (SELECT {_CRC_TABLE_SQL} AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.RUN}')) AS run FROM documents),
marked AS (SELECT run, n, {_crc32_sql(octets, "t")} AS h
           FROM (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS x, run, count(*) AS n FROM found GROUP BY 1, 2), lookup),
worn AS (SELECT CASE WHEN h % {WEAR} = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, n FROM marked),
words AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS m FROM worn WHERE length(word) >= {options.least_length} GROUP BY word HAVING sum(n) >= {options.least_count}),
cuts AS (SELECT word, n, m, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS k FROM cuts x JOIN cuts y ON x.m = y.m AND x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON y.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, max(k) AS top FROM pairs GROUP BY word),
chosen AS (SELECT p.word, b.n_near, b.top, min(p.other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.k = b.top GROUP BY p.word, b.n_near, b.top),
judged AS (SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.top >= {options.ratio} * w.n THEN c.other END AS form,
                  CASE WHEN c.top >= {options.ratio} * w.n THEN c.top END AS form_n FROM words w LEFT JOIN chosen c ON c.word = w.word),
chain(word, reached) AS (SELECT word, word FROM judged UNION SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.reached WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.reached AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN chain c ON c.word = j.word JOIN judged e ON e.word = c.reached AND e.form IS NULL
"""


@query(_spelling_sql(spelling.Spelling()))
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the worn runs of all texts."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
    words = found.select(spelling.worn(F.col("doc_id"), F.col("run"), WEAR).alias("word"))
    return spelling.variants(spelling.word_counts(words, "word", spelling.Spelling()))
