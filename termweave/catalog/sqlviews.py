"""The views of `catalog.views` as SQL common table expressions for the oracle."""

URL = "http://hl7.org/fhir/sid/icd-10-cm"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "type_rank": ((), "SELECT p_type, row_number() OVER (ORDER BY p_type) AS tr FROM (SELECT DISTINCT p_type FROM part)"),
    "part_seq": (
        ("type_rank",),
        """SELECT p_partkey, p_name, p_brand, p.p_type, p_size, tr, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS bn,
           row_number() OVER (PARTITION BY p.p_type, p_brand ORDER BY p_partkey) - 1 AS seq
           FROM part p JOIN type_rank t ON p.p_type = t.p_type""",
    ),
    "part_code": (
        ("part_seq",),
        """SELECT *, chr(CAST(tr + 64 AS INTEGER)) || lpad(CAST(bn AS VARCHAR), 2, '0') AS category,
           chr(CAST(tr + 64 AS INTEGER)) || lpad(CAST(bn AS VARCHAR), 2, '0') || '.'
             || CASE WHEN seq // 3 < 1000 THEN lpad(CAST(seq // 3 AS VARCHAR), 3, '0') ELSE CAST(seq // 3 AS VARCHAR) END
             || substr('ADS', CAST(seq % 3 + 1 AS INTEGER), 1) AS code,
           (tr * 100 + bn) * 1000000000 AS base_order FROM part_seq""",
    ),
    "header": (
        ("part_code",),
        """SELECT DISTINCT v.version, v.tag, category, tr, bn, p_type, p_brand, base_order, l.level
           FROM part_code CROSS JOIN (VALUES ('2027', 27, 1000000), ('2026', 26, 45)) v(version, tag, biggest)
           CROSS JOIN (VALUES (0), (1), (2)) l(level) WHERE p_size <= v.biggest""",
    ),
    "concept_all": (
        ("part_code", "header"),
        f"""SELECT '{URL}' AS canonical_url, v.version, (p_partkey + 1) * 100 + v.tag AS concept_id, code,
           p_name || ' ' || lower(p_type) || ' size ' || p_size AS display, p_name AS short_display, TRUE AS is_billable,
           base_order + 10 + seq AS sort_order, CAST(NULL AS VARCHAR) AS note_key, CAST(NULL AS VARCHAR) AS note, category, p_partkey
           FROM part_code CROSS JOIN (VALUES ('2027', 27, 1000000), ('2026', 26, 45)) v(version, tag, biggest)
           WHERE p_size <= v.biggest
           UNION ALL
           SELECT '{URL}', version, -(((tr * 100 + bn) * 10 + level) * 100 + tag),
           category || CASE level WHEN 0 THEN '' WHEN 1 THEN '.0' ELSE '.00' END, p_type || ' ' || p_brand, p_brand, FALSE,
           base_order + level, CASE level WHEN 0 THEN 'includes' WHEN 2 THEN 'code_also' END,
           CASE level WHEN 0 THEN p_type || ' goods' WHEN 2 THEN lower(p_brand) END, category, NULL FROM header""",
    ),
    "concept": (("concept_all",), "SELECT * FROM concept_all WHERE version = '2027'"),
    "compact": (
        ("concept_all",),
        "SELECT *, replace(code, '.', '') AS cc FROM concept_all",
    ),
    "prefix_all": (
        ("compact",),
        """SELECT canonical_url, version, concept_id, code, is_billable, sort_order, n,
           CASE WHEN n <= 3 THEN substr(cc, 1, n) ELSE substr(cc, 1, 3) || '.' || substr(cc, 4, n - 3) END AS prefix,
           length(cc) AS len FROM (SELECT *, unnest(range(3, length(cc) + 1)) AS n FROM compact)""",
    ),
    "parent": (
        ("prefix_all", "concept_all"),
        """SELECT p.version, p.code, max_by(p.prefix, p.n) AS parent_code FROM prefix_all p
           JOIN concept_all k ON k.version = p.version AND k.code = p.prefix WHERE p.n < p.len GROUP BY 1, 2""",
    ),
    "synonym": (
        ("concept",),
        """SELECT version, code, concept_id, array_to_string(list_reverse(string_split(short_display, ' ')), ' ') AS synonym
           FROM concept WHERE is_billable""",
    ),
    "index_entry": (
        ("part_code",),
        """SELECT min(p_partkey) AS term_id, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS term, category AS code,
           CASE WHEN split_part(p_name, ' ', 1) IN ('blue', 'cold', 'hot') THEN 0
                WHEN split_part(p_name, ' ', 1) IN ('large', 'new') THEN 1 ELSE 2 END AS depth, FALSE AS via_see, tr, bn,
           CAST('0x' || substr(sha1(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand)), 1, 8) AS BIGINT) % 100 < 20 AS held_out
           FROM part_code GROUP BY p_name, p_type, p_brand, category, tr, bn""",
    ),
    "index_term": (
        ("index_entry",),
        """SELECT term_id, -(((tr * 100 + bn) * 10) * 100 + 27) AS concept_id, term, code, depth, via_see
           FROM index_entry WHERE NOT held_out""",
    ),
    "eval_query": (
        ("index_entry",),
        """SELECT 'idx-' || term_id AS query_id, term AS query, code AS gold,
           CASE depth WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2+' END AS depth FROM index_entry WHERE held_out""",
    ),
    "candidate_row": (
        ("part_code",),
        """SELECT l_orderkey AS query_id, CASE WHEN l_returnflag = 'N' THEN 'semantic' ELSE 'text' END AS method,
           CASE WHEN l_linestatus = 'O' THEN -(((tr * 100 + bn) * 10) * 100 + 27) ELSE (l_partkey + 1) * 100 + 27 END AS concept_id,
           l_extendedprice / 100000 AS score,
           CASE WHEN l_linestatus = 'O' THEN p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) END AS matched_on,
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS source, l_linenumber AS source_rank
           FROM lineitem JOIN part_code ON p_partkey = l_partkey""",
    ),
}


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """`WITH ...` with the named views, their dependencies in order, and `extra` at the end."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
