"""Queries for the code-system, hierarchy and index-term operators."""

from pyspark.sql import functions as F

from termweave.catalog import views as V
from termweave.catalog.registry import query
from termweave.catalog.sqlviews import with_ctes
from termweave.functions import codes as K
from termweave.operators import hierarchy as H
from termweave.operators import indexterms as IX

RAW_CODES = """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN lower(replace(code, '.', '')) WHEN 'Brand#2' THEN category || '.-'
  WHEN 'Brand#3' THEN p_name WHEN 'Brand#4' THEN ' ' || category || '. ' ELSE code END AS raw FROM part_code"""


def raw_codes(spark, sf):
    """Part codes as users type them: undotted lower case, category dashes, names, trailing dots."""
    p = V.part_codes(spark, sf)
    raw = (
        F.when(F.col("p_brand") == "Brand#1", F.lower(F.replace("code", F.lit("."), F.lit(""))))
        .when(F.col("p_brand") == "Brand#2", F.concat("category", F.lit(".-")))
        .when(F.col("p_brand") == "Brand#3", F.col("p_name"))
        .when(F.col("p_brand") == "Brand#4", F.concat(F.lit(" "), "category", F.lit(". ")))
        .otherwise(F.col("code"))
    )
    return p.select("p_partkey", raw.alias("raw"))


_COMPACT = "upper(trim(replace(raw, '.', '')))"


@query(
    "to_dotted",
    with_ctes("part_code", extra={"r": RAW_CODES})
    + f"""SELECT p_partkey, CASE WHEN length({_COMPACT}) <= 3 THEN {_COMPACT}
    ELSE substr({_COMPACT}, 1, 3) || '.' || substr({_COMPACT}, 4) END AS dotted FROM r""",
)
def to_dotted(spark, sf):
    return raw_codes(spark, sf).select("p_partkey", K.to_dotted(F.col("raw")).alias("dotted"))


@query(
    "is_code_like",
    with_ctes("part_code", extra={"r": RAW_CODES})
    + r"SELECT p_partkey, regexp_matches(trim(raw), '^[A-Za-z][0-9][0-9A-Za-z](\.?[0-9A-Za-z]{0,4})?$') AS code_like FROM r",
)
def is_code_like(spark, sf):
    return raw_codes(spark, sf).select("p_partkey", K.is_code_like(F.col("raw")).alias("code_like"))


@query(
    "code_prefix",
    with_ctes("part_code", extra={"r": RAW_CODES})
    + "SELECT p_partkey, rtrim(rtrim(trim(raw), '-'), '.') AS prefix FROM r",
)
def code_prefix(spark, sf):
    return raw_codes(spark, sf).select("p_partkey", K.code_prefix(F.col("raw")).alias("prefix"))


@query(
    "variant_stem",
    with_ctes("concept_all")
    + """SELECT version, code, CASE WHEN length(replace(code, '.', '')) = 7 THEN left(code, length(code) - 1) ELSE code END AS stem
    FROM concept_all""",
)
def variant_stem(spark, sf):
    return V.concepts(spark, sf, None).select("version", "code", K.variant_stem(F.col("code")).alias("stem"))


@query(
    "normalise_codes",
    with_ctes("part_code", extra={"r": RAW_CODES, "d": f"""SELECT p_partkey, raw, CASE WHEN length({_COMPACT}) <= 3 THEN {_COMPACT}
    ELSE substr({_COMPACT}, 1, 3) || '.' || substr({_COMPACT}, 4) END AS dotted FROM r"""})
    + r"""SELECT p_partkey, dotted, regexp_matches(trim(raw), '^[A-Za-z][0-9][0-9A-Za-z](\.?[0-9A-Za-z]{0,4})?$') AS code_like,
    rtrim(rtrim(trim(raw), '-'), '.') AS prefix,
    CASE WHEN length(replace(dotted, '.', '')) = 7 THEN left(dotted, length(dotted) - 1) ELSE dotted END AS stem FROM d""",
)
def normalise_codes(spark, sf):
    return K.normalise_codes(raw_codes(spark, sf), "raw").select("p_partkey", "dotted", "code_like", "prefix", "stem")


@query(
    "derive_parent",
    with_ctes("concept_all", "parent")
    + "SELECT c.version, c.code, p.parent_code FROM concept_all c LEFT JOIN parent p ON p.version = c.version AND p.code = c.code",
)
def derive_parent(spark, sf):
    return H.derive_parent(V.concepts(spark, sf, None)).select("version", "code", "parent_code")


@query(
    "billable_descendants",
    with_ctes("concept_all", "prefix_all")
    + """SELECT p.version, p.prefix AS category, p.code AS child_code, p.sort_order AS child_order FROM prefix_all p
    JOIN concept_all c ON c.version = p.version AND c.code = p.prefix AND NOT c.is_billable WHERE p.is_billable""",
)
def billable_descendants(spark, sf):
    return H.billable_descendants(V.concepts(spark, sf, None)).select("version", "category", "child_code", "child_order")


@query(
    "children",
    with_ctes("concept_all", "parent")
    + """SELECT c.version, p.parent_code, c.code AS child_code, c.sort_order AS child_order
    FROM concept_all c JOIN parent p ON p.version = c.version AND p.code = c.code""",
)
def children(spark, sf):
    return H.children(V.hierarchy(spark, sf)).select("version", "parent_code", "child_code", "child_order")


@query(
    "inherited_notes",
    "WITH RECURSIVE " + with_ctes("concept_all", "parent")[5:]
    + """, up AS (SELECT version, code, parent_code AS ancestor, 1 AS depth FROM parent
      UNION ALL SELECT u.version, u.code, p.parent_code, u.depth + 1 FROM up u JOIN parent p ON p.version = u.version AND p.code = u.ancestor)
    SELECT u.version, u.code, u.ancestor, u.depth, c.display AS ancestor_display, c.note_key || ': ' || c.note AS notes
    FROM up u JOIN concept_all c ON c.version = u.version AND c.code = u.ancestor WHERE c.note IS NOT NULL""",
)
def inherited_notes(spark, sf):
    notes = H.inherited_notes(V.hierarchy(spark, sf))
    flat = F.array_join(F.transform(F.map_entries("notes"), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], "; "))), " | ")
    return notes.select("version", "code", "ancestor", "depth", "ancestor_display", flat.alias("notes"))


@query("concept_detail")
def concept_detail(spark, sf):
    """Details of every category that an order line touches, looked up undotted."""
    concepts = V.hierarchy(spark, sf).where(F.col("version") == V.CURRENT)
    touched = V.table(spark, sf, "lineitem").select("l_partkey").distinct()
    lookups = (
        concepts.join(touched, concepts.p_partkey == touched.l_partkey)
        .select("canonical_url", "version", F.lower(F.replace(F.col("parent_code"), F.lit("."), F.lit(""))).alias("code"))
    )
    return H.concept_detail(concepts, V.synonyms(spark, sf), lookups)


@query(
    "has_billable",
    with_ctes("part_code", "prefix_all", extra={"wanted": "SELECT DISTINCT 'A' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS prefix FROM part"})
    + "SELECT w.prefix FROM wanted w WHERE EXISTS (SELECT 1 FROM prefix_all p WHERE p.version = '2027' AND p.is_billable AND p.prefix = w.prefix)",
)
def has_billable(spark, sf):
    sizes = V.table(spark, sf, "part").select("p_size").distinct()
    prefixes = sizes.select(F.concat(F.lit("A"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("prefix"))
    return H.has_billable(prefixes, V.concepts(spark, sf))


@query(
    "latest_release",
    with_ctes("concept_all")
    + "SELECT canonical_url, max(version) AS version, 'ICD-10-CM' AS name, TRUE AS active FROM concept_all GROUP BY 1",
)
def latest_release(spark, sf):
    return H.latest_release(V.code_systems(spark, sf)).select("canonical_url", "version", "name", "active")


@query(
    "coverage",
    with_ctes("concept_all", "index_term", extra={
        "c": """SELECT version, count(*) AS concept_count, count(vec_id) AS embedded_count FROM concept_all
                LEFT JOIN embeddings ON vec_id = p_partkey AND version = '2027' GROUP BY 1""",
        "t": "SELECT '2027' AS version, count(*) AS n, count(vec_id) AS e FROM index_term LEFT JOIN embeddings ON vec_id = term_id",
    })
    + """SELECT c.version, concept_count, embedded_count, coalesce(t.n, 0) AS index_term_count, coalesce(t.e, 0) AS index_terms_embedded,
    round(CAST(embedded_count AS DOUBLE) / concept_count, 6) AS embedded_share FROM c LEFT JOIN t ON t.version = c.version""",
)
def coverage(spark, sf):
    """Vectors stand for the current release's leaves and for index terms of the same part."""
    concepts = V.concepts(spark, sf, None)
    vec = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    leaf = concepts.where(F.col("version") == V.CURRENT).join(vec, "p_partkey")
    terms = V.index_terms(spark, sf)
    term_vectors = terms.join(vec, terms.term_id == vec.p_partkey)
    stored = leaf.select(F.lit("code").alias("source"), F.col("concept_id").alias("row_id")).unionByName(
        term_vectors.select(F.lit("index").alias("source"), F.col("term_id").alias("row_id"))
    ).withColumn("model", F.lit("m64"))
    out = H.coverage(V.code_systems(spark, sf), concepts, terms, stored, "m64")
    return out.select(
        "version", "concept_count", "embedded_count", "index_term_count", "index_terms_embedded",
        F.round("embedded_share", 6).alias("embedded_share"),
    )


@query(
    "find_billable",
    with_ctes("part_code", "concept", extra={"r": RAW_CODES, "d": f"""SELECT p_partkey, CASE WHEN length({_COMPACT}) <= 3 THEN {_COMPACT}
    ELSE substr({_COMPACT}, 1, 3) || '.' || substr({_COMPACT}, 4) END AS code FROM r"""})
    + "SELECT d.p_partkey, c.version, d.code, c.concept_id, c.display FROM d JOIN concept c ON c.code = d.code AND c.is_billable",
)
def find_billable(spark, sf):
    lookups = raw_codes(spark, sf).select("p_partkey", F.lit(K.ICD10CM_URL).alias("canonical_url"), F.col("raw").alias("code"))
    found = H.find_billable(lookups, V.code_systems(spark, sf), V.concepts(spark, sf, None))
    return found.select("p_partkey", "version", "code", "concept_id", "display")


@query("synonyms", with_ctes("synonym") + "SELECT DISTINCT code, concept_id, synonym FROM synonym")
def synonyms(spark, sf):
    """Parts of the previous catalogue offer names too; those without a current concept drop out."""
    tabular = V.synonyms(spark, sf).select("canonical_url", "version", "code", "synonym")
    gone = tabular.withColumn("code", F.concat("code", F.lit("Z")))
    return H.synonyms(tabular.unionByName(gone).unionByName(tabular), V.concepts(spark, sf)).select("code", "concept_id", "synonym")


@query(
    "category_expansion",
    with_ctes("concept_all", "prefix_all", extra={
        "r": """SELECT p.version, p.prefix AS category, p.code, p.sort_order,
                CASE WHEN length(replace(p.code, '.', '')) = 7 THEN left(p.code, length(p.code) - 1) ELSE p.code END AS stem
                FROM prefix_all p JOIN concept_all c ON c.version = p.version AND c.code = p.prefix AND NOT c.is_billable WHERE p.is_billable""",
        "f": "SELECT version, category, stem, min(sort_order) AS first FROM r GROUP BY 1, 2, 3",
        "o": "SELECT *, row_number() OVER (PARTITION BY version, category ORDER BY first) AS n FROM f",
        "w": """SELECT r.*, row_number() OVER (PARTITION BY r.version, r.category ORDER BY r.sort_order) - 1 AS i,
                coalesce((SELECT min(o.first) FROM o WHERE o.version = r.version AND o.category = r.category AND o.n = 11), 9e18) AS cut FROM r""",
    })
    + "SELECT version, category, code AS child_code, stem, i FROM w WHERE sort_order < cut",
)
def category_expansion(spark, sf):
    return H.category_expansion(V.concepts(spark, sf, None)).select("version", "category", "child_code", "stem", "i")


# ── index terms ──


def index_nodes(spark, sf):
    """The index tree the parts span: noun > adjective > type > brand, and see references to it."""
    p = V.part_codes(spark, sf)
    adj, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind, brand = F.lower("p_type"), F.lower("p_brand")
    grouped = p.groupBy("p_name", "p_type", "p_brand", "category").agg(F.min("p_partkey").alias("k"))
    title = F.concat(noun, F.lit(", "), noun, F.lit("s"))
    null = F.lit(None).cast("string")
    coded = grouped.select(
        F.array(title, adj, kind, brand).alias("path"), F.lit(3).alias("depth"),
        F.concat("category", F.lit(".-")).alias("code"), null.alias("see"), (F.col("k") * 10).alias("ordinal"),
    )
    see = grouped.select(
        F.array(adj, noun, kind, brand).alias("path"), F.lit(3).alias("depth"), null.alias("code"),
        F.concat_ws(", ", F.concat(noun, F.lit("s")), adj, F.concat_ws(" ", kind, brand)).alias("see"),
        (F.col("k") * 10 + 5).alias("ordinal"),
    )
    lost = grouped.groupBy("p_name", "p_type").agg(F.min("k").alias("k")).select(
        F.array(title, adj, kind).alias("path"), F.lit(2).alias("depth"),
        F.when(F.col("p_type") == "PROMO", F.lit("Z99.9-")).alias("code"),
        F.lit("condition").alias("see"), (F.col("k") * 10 + 1).alias("ordinal"),
    )
    return coded.unionByName(see).unionByName(lost)


_G = {
    "g": """SELECT split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, lower(p_type) AS kind, lower(p_brand) AS brand,
            category, min(p_partkey) AS k FROM part_code GROUP BY p_name, p_type, p_brand, category""",
    "direct": """SELECT noun || ', ' || noun || 's ' || adj || ' ' || kind || ' ' || brand AS term, category AS code, 3 AS depth,
            FALSE AS via_see, k * 10 AS ordinal FROM g
            UNION ALL SELECT noun || ', ' || noun || 's ' || adj || ' ' || kind, 'Z99.9', 2, FALSE, min(k) * 10 + 1 FROM g WHERE kind = 'promo' GROUP BY noun, adj, kind""",
    "alias": """SELECT alias_key, min_by(code, ordinal) AS code FROM (
            SELECT unnest([noun || ' ' || noun || 's ', noun || ' ', noun || 's ']) || adj || ' ' || kind || ' ' || brand AS alias_key, category AS code, k * 10 AS ordinal FROM g
            UNION ALL SELECT unnest([noun || ' ' || noun || 's ', noun || ' ', noun || 's ']) || adj || ' ' || kind, 'Z99.9', min(k) * 10 + 1 FROM g WHERE kind = 'promo' GROUP BY noun, adj, kind) GROUP BY 1""",
    "see": """SELECT adj || ' ' || noun || ' ' || kind || ' ' || brand AS term, a.code, 3 AS depth, TRUE AS via_see, k * 10 + 5 AS ordinal
            FROM g JOIN alias a ON a.alias_key = noun || 's ' || adj || ' ' || kind || ' ' || brand""",
    "term": "SELECT * FROM direct UNION ALL SELECT * FROM see",
    "split": """SELECT *, CAST('0x' || substr(sha1(trim(regexp_replace(replace(lower(term), ',', ' '), '\\s+', ' ', 'g'))), 1, 8) AS BIGINT) % 100 < 20 AS held_out FROM term""",
}


def _g(*names: str) -> dict[str, str]:
    upto = max(list(_G).index(n) for n in names)
    return dict(list(_G.items())[: upto + 1])


@query(
    "norm_text",
    "SELECT page_id, trim(regexp_replace(replace(lower(replace(url, '/', ' , ')), ',', ' '), '\\s+', ' ', 'g')) AS norm FROM pages",
)
def norm_text(spark, sf):
    pages = V.table(spark, sf, "pages")
    return pages.select("page_id", K.norm_text(F.replace("url", F.lit("/"), F.lit(" , "))).alias("norm"))


@query("direct_terms", with_ctes("part_code", extra=_g("direct")) + "SELECT term, code, depth, via_see FROM direct")
def direct_terms(spark, sf):
    return IX.direct_terms(index_nodes(spark, sf)).select("term", "code", "depth", "via_see")


@query("path_aliases", with_ctes("part_code", extra=_g("alias")) + "SELECT alias_key, code FROM alias")
def path_aliases(spark, sf):
    return IX.path_aliases(index_nodes(spark, sf))


@query("resolve_see", with_ctes("part_code", extra=_g("see")) + "SELECT term, code, depth, via_see FROM see")
def resolve_see(spark, sf):
    nodes = index_nodes(spark, sf)
    return IX.resolve_see(nodes, IX.path_aliases(nodes)).select("term", "code", "depth", "via_see")


def all_terms(spark, sf):
    nodes = index_nodes(spark, sf)
    return IX.direct_terms(nodes).unionByName(IX.resolve_see(nodes, IX.path_aliases(nodes)))


@query("holdout_split", with_ctes("part_code", extra=_g("split")) + "SELECT term, code, via_see, held_out FROM split")
def holdout_split(spark, sf):
    return IX.holdout_split(all_terms(spark, sf), V.HOLDOUT_PERCENT).select("term", "code", "via_see", "held_out")


@query(
    "link_terms",
    with_ctes("concept", "part_code", extra=_g("split"))
    + """SELECT c.concept_id, s.code, s.term, min(s.depth) AS depth, bool_and(s.via_see) AS via_see FROM split s
    JOIN concept c ON c.code = s.code WHERE NOT held_out GROUP BY 1, 2, 3""",
)
def link_terms(spark, sf):
    return IX.link_terms(all_terms(spark, sf), V.concepts(spark, sf), V.HOLDOUT_PERCENT)


@query(
    "link_report",
    with_ctes("concept", "part_code", extra=_g("split"))
    + """SELECT CASE WHEN held_out THEN 'held_out' WHEN c.code IS NULL THEN 'unknown_code' ELSE 'linked' END AS status, via_see,
    count(*) AS terms FROM split s LEFT JOIN concept c ON c.code = s.code GROUP BY 1, 2""",
)
def link_report(spark, sf):
    return IX.link_report(all_terms(spark, sf), V.concepts(spark, sf), V.HOLDOUT_PERCENT)
