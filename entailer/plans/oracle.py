"""Independent SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the derived graph from the base tables with plain SQL
and applies the rule as joins; closures use ``WITH RECURSIVE ... UNION``
(set semantics, so cycles terminate) and the OWL fixpoint is unrolled into
``OWL_ROUNDS`` naive rounds, each a materialised CTE. Column names equal the
Spark side's.
"""

from __future__ import annotations

from entailer.functions import vocab as V
from entailer.functions.vocab import expand_curie_sql
from entailer.plans.testgraph import AXIOMS, MERGE_AXIOMS, PER_VALUE

# Naive rounds unrolled by the OWL materialisation oracle. The derived graph
# reaches its fixpoint after 4 productive rounds; more rounds are harmless.
OWL_ROUNDS = 8
# Rounds of rules and merging together; a test asserts that the last one adds nothing.
MERGE_ROUNDS = 12

TYPE, SAME = V.RDF_TYPE, V.OWL_SAME_AS

ABOX_RAW = """
select 'ex:cust'||c_custkey s,'rdf:type' p,'ex:Nation'||c_nationkey o from customer union all
select 'ex:supp'||s_suppkey,'rdf:type','ex:Nation'||s_nationkey from supplier union all
select 'ex:part'||p_partkey,'rdf:type','ex:PT_'||p_type from part union all
select 'ex:ord'||o_orderkey,'ex:placedBy','ex:cust'||o_custkey from orders union all
select 'ex:ord'||o_orderkey,'ex:priority','ex:pr_'||replace(o_orderpriority,' ','_') from orders union all
select 'ex:ord'||o_orderkey,'rdf:type','ex:FilledOrder' from orders where o_orderstatus='F' union all
select 'ex:ord'||o_orderkey,'rdf:type','ex:OpenOrder' from orders where o_orderstatus='O' union all
select 'ex:ord'||l_orderkey,'ex:hasPart','ex:part'||l_partkey from lineitem union all
select 'ex:part'||a.l_partkey,'ex:boughtWith','ex:part'||b.l_partkey from lineitem a join lineitem b
       on a.l_orderkey=b.l_orderkey and b.l_linenumber=a.l_linenumber+1 union all
select 'ex:conv'||conv_id||'_'||turn,'ex:replyTo','ex:conv'||conv_id||'_'||(turn-1)
       from conversations where turn>0 union all
select 'ex:doc'||doc_id,'ex:textHash','ex:h'||md5(text) from documents union all
select 'ex:h'||md5(text),'ex:firstDoc','ex:doc'||doc_id from documents union all
select 'ex:doc'||doc_id,'ex:source_'||replace(source,' ','_'),'ex:'||replace(source,' ','_') from documents
"""


MERGE_ABOX = """
select 'ex:doc'||doc_id s,'rdf:type' p,'ex:Quality'||quality o from labels union all
select 'ex:rev'||doc_id,'ex:reviews','ex:doc'||doc_id from documents union all
select 'ex:rev'||doc_id,'ex:award','ex:prize_'||replace(source,' ','_') from documents union all
select 'ex:prize_'||replace(source,' ','_'),'ex:givenBy','ex:'||replace(source,' ','_') from documents
"""


def _tbox_raw(axioms=AXIOMS) -> str:
    def term(template: str, column: str) -> str:
        head, found, tail = template.partition("{}")
        return f"'{head}'" + (f"||replace({column},' ','_')||'{tail}'" if found else "")

    per_value = "".join(
        f"select distinct {term(s, c)},'{p}',{term(o, c)} from {t} where {c} is not null union all\n"
        for t, c, s, p, o in PER_VALUE)
    values = ",\n ".join(f"('{s}','{p}','{o}')" for s, p, o in axioms)
    return f"""
select 'ex:Nation'||n_nationkey s,'rdfs:subClassOf' p,'ex:Region'||n_regionkey o from nation union all
select 'ex:Region'||r_regionkey,'rdfs:subClassOf','ex:Place' from region union all
{per_value}select * from (values
 {values}) v(s, p, o)
"""


def _norm(src: str) -> str:
    return (f"SELECT DISTINCT {expand_curie_sql('s')} AS s, {expand_curie_sql('p')} AS p, "
            f"{expand_curie_sql('o')} AS o FROM {src} "
            "WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def _kind(cls: str) -> str:
    return f"SELECT DISTINCT s AS prop FROM tbox WHERE p = '{TYPE}' AND o = '{cls}'"


def _restr(pred: str) -> str:
    return (f"SELECT DISTINCT k.s AS v, q.o AS prop, k.o AS filler FROM tbox k "
            f"JOIN tbox q ON q.s = k.s AND q.p = '{V.OWL_ON_PROPERTY}' WHERE k.p = '{pred}'")


def _closure(name: str, pred: str) -> str:
    return (f"{name}_e AS (SELECT DISTINCT s, o FROM tbox WHERE p = '{pred}'),\n"
            f"{name}(s, o) AS (SELECT s, o FROM {name}_e UNION "
            f"SELECT c.s, e.o FROM {name} c JOIN {name}_e e ON c.o = e.s)")


# CTEs every statement may use (unused ones cost nothing).
def _prelude(abox: str = ABOX_RAW, axioms=AXIOMS) -> str:
    ctes = [
        f"abox_raw AS ({abox})",
        f"tbox_raw AS ({_tbox_raw(axioms)})",
        f"abox AS MATERIALIZED ({_norm('abox_raw')})",
        f"tbox AS MATERIALIZED ({_norm('tbox_raw')})",
        _closure("sc", V.RDFS_SUBCLASS_OF),
        _closure("sp", V.RDFS_SUBPROPERTY_OF),
        f"dom AS (SELECT DISTINCT s, o FROM tbox WHERE p = '{V.RDFS_DOMAIN}')",
        f"rng AS (SELECT DISTINCT s, o FROM tbox WHERE p = '{V.RDFS_RANGE}')",
        f"inv AS (SELECT s AS prop, o AS inv FROM tbox WHERE p = '{V.OWL_INVERSE_OF}' "
        f"UNION SELECT o, s FROM tbox WHERE p = '{V.OWL_INVERSE_OF}')",
        f"fp AS ({_kind(V.OWL_FUNCTIONAL_PROPERTY)})",
        f"ifp AS ({_kind(V.OWL_INVERSE_FUNCTIONAL_PROPERTY)})",
        f"sym AS ({_kind(V.OWL_SYMMETRIC_PROPERTY)})",
        f"trp AS ({_kind(V.OWL_TRANSITIVE_PROPERTY)})",
        f"hv AS ({_restr(V.OWL_HAS_VALUE)})",
        f"svf AS ({_restr(V.OWL_SOME_VALUES_FROM)})",
        f"avf AS ({_restr(V.OWL_ALL_VALUES_FROM)})",
    ]
    return "WITH RECURSIVE\n" + ",\n".join(ctes)


def _with(*ctes: str) -> str:
    return "".join(",\n" + c for c in ctes)


IS_SCHEMA = (
    "p IN (" + ", ".join(f"'{x}'" for x in V.SCHEMA_PREDICATES) + f") OR (p = '{TYPE}' AND o IN ("
    + ", ".join(f"'{x}'" for x in V.PROPERTY_CLASSES) + "))"
)


def _links_fp(f: str) -> str:
    """OWL 1 star links over fact table ``f``: object -> smallest object of (s, p)."""
    return f"""
SELECT t.o AS s, '{SAME}' AS p, g.rep AS o FROM (SELECT DISTINCT * FROM {f} WHERE p IN (SELECT prop FROM fp)) t
  JOIN (SELECT s, p, min(o) AS rep FROM {f} WHERE p IN (SELECT prop FROM fp) GROUP BY s, p) g
  ON t.s = g.s AND t.p = g.p WHERE t.o <> g.rep"""


def _links_ifp(f: str) -> str:
    """OWL 2 star links over fact table ``f``: subject -> smallest subject of (p, o)."""
    return f"""
SELECT t.s AS s, '{SAME}' AS p, g.rep AS o FROM (SELECT DISTINCT * FROM {f} WHERE p IN (SELECT prop FROM ifp)) t
  JOIN (SELECT p, o, min(s) AS rep FROM {f} WHERE p IN (SELECT prop FROM ifp) GROUP BY p, o) g
  ON t.p = g.p AND t.o = g.o WHERE t.s <> g.rep"""


def _links(f: str) -> str:
    return _links_fp(f) + "\nUNION\n" + _links_ifp(f)


def _rules(f: str, transitive: bool = False, of: str = "") -> str:
    """Every RDFS/OWL rule of the fixpoint applied once to fact table ``f``.

    ``of`` is the suffix of the rule tables whose classes and values were merged.
    """
    trans = (f"\nUNION ALL SELECT a.s, a.p, b.o FROM {f} a JOIN {f} b ON a.p = b.p AND a.o = b.s "
             "WHERE a.p IN (SELECT prop FROM trp)") if transitive else ""
    return f"""
SELECT x.s, sp.o AS p, x.o FROM {f} x JOIN sp ON x.p = sp.s
UNION ALL SELECT x.s, '{TYPE}', d.o FROM {f} x JOIN dom{of} d ON x.p = d.s
UNION ALL SELECT x.o, '{TYPE}', r.o FROM {f} x JOIN rng{of} r ON x.p = r.s
UNION ALL SELECT x.s, '{TYPE}', c.o FROM {f} x JOIN sc{of} c ON x.p = '{TYPE}' AND x.o = c.s
UNION ALL SELECT x.o, x.p, x.s FROM {f} x WHERE x.p IN (SELECT prop FROM sym)
UNION ALL SELECT x.o, i.inv, x.s FROM {f} x JOIN inv i ON x.p = i.prop
UNION ALL SELECT x.s, '{TYPE}', h.v FROM {f} x JOIN hv{of} h ON x.p = h.prop AND x.o = h.filler
UNION ALL SELECT x.s, h.prop, h.filler FROM {f} x JOIN hv{of} h ON x.p = '{TYPE}' AND x.o = h.v
UNION ALL SELECT e.s, '{TYPE}', r.v FROM {f} e JOIN svf{of} r ON e.p = r.prop
  JOIN {f} t ON t.p = '{TYPE}' AND t.s = e.o AND t.o = r.filler
UNION ALL SELECT e.o, '{TYPE}', r.filler FROM {f} e JOIN avf{of} r ON e.p = r.prop
  JOIN {f} t ON t.p = '{TYPE}' AND t.s = e.s AND t.o = r.v""" + trans


def _clusters_ctes() -> tuple[str, ...]:
    return (
        f"lnk AS ({_links('abox')} UNION SELECT s, p, o FROM abox WHERE p = '{SAME}')",
        "und(a, b) AS (SELECT s, o FROM lnk WHERE s <> o UNION SELECT o, s FROM lnk WHERE s <> o)",
        "reach(a, b) AS (SELECT a, b FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON r.b = u.a)",
        "comp AS (SELECT a AS member, min(b) AS id FROM "
        "(SELECT a, b FROM reach UNION SELECT a, a FROM und) GROUP BY a)",
        "cl AS (SELECT member, id FROM comp WHERE member <> id)",
    )


def _owl_rounds(transitive: bool = False) -> tuple[str, ...]:
    ctes = ["f0 AS MATERIALIZED (SELECT s, p, o FROM abox)"]
    for i in range(1, OWL_ROUNDS + 1):
        ctes.append(f"f{i} AS MATERIALIZED (SELECT s, p, o FROM f{i - 1} UNION "
                    f"SELECT * FROM ({_rules(f'f{i - 1}', transitive)}) r)")
    return tuple(ctes)


def _merged_rounds() -> tuple[str, ...]:
    """Rounds of rules and merging: facts ``m{i}`` over the clusters ``q{i}`` found so far."""
    def to_ids(src: str, i: int, cols: str, *terms: str) -> str:
        joins = " ".join(f"LEFT JOIN q{i} q{t} ON q{t}.member = x.{t}" for t in terms)
        picked = ", ".join(f"coalesce(q{c}.id, x.{c}) AS {c}" if c in terms else f"x.{c}" for c in cols.split())
        return f"SELECT DISTINCT {picked} FROM {src} x {joins}"

    ctes = ["m0 AS MATERIALIZED (SELECT s, p, o FROM abox)",
            "q0 AS MATERIALIZED (SELECT '' AS member, '' AS id WHERE false)"]
    for i in range(1, MERGE_ROUNDS + 1):
        a, tables = i - 1, f"_{i - 1}"
        for name in ("dom", "rng"):
            ctes.append(f"{name}{tables} AS MATERIALIZED ({to_ids(name, a, 's o', 'o')})")
        ctes.append(f"sc{tables} AS MATERIALIZED ({to_ids('sc', a, 's o', 's', 'o')})")
        for name in ("hv", "svf", "avf"):
            ctes.append(f"{name}{tables} AS MATERIALIZED ({to_ids(name, a, 'v prop filler', 'v', 'filler')})")
        ctes += [
            f"link{i} AS MATERIALIZED (SELECT s, o FROM ({_links(f'm{a}')}) l "
            f"UNION SELECT s, o FROM m{a} WHERE p = '{SAME}' AND s <> o UNION SELECT member, id FROM q{a})",
            f"und{i}(a, b) AS (SELECT s, o FROM link{i} UNION SELECT o, s FROM link{i})",
            f"reach{i}(a, b) AS (SELECT a, b FROM und{i} UNION "
            f"SELECT r.a, u.b FROM reach{i} r JOIN und{i} u ON r.b = u.a)",
            f"q{i} AS MATERIALIZED (SELECT a AS member, min(b) AS id FROM reach{i} GROUP BY a HAVING min(b) <> a)",
            f"n{i} AS MATERIALIZED (SELECT s, p, o FROM m{a} UNION ALL SELECT * FROM ({_rules(f'm{a}', of=tables)}) r)",
            f"m{i} AS MATERIALIZED ({to_ids(f'n{i}', i, 's p o', 's', 'o')})",
        ]
    return tuple(ctes)


def _clusters_over(f: str) -> tuple[str, ...]:
    """Connected components (member, id) of the sameAs facts of ``f`` plus its OWL 1/2 links."""
    return (
        f"flnk AS ({_links(f)} UNION SELECT s, p, o FROM {f} WHERE p = '{SAME}')",
        "fund(a, b) AS (SELECT s, o FROM flnk WHERE s <> o UNION SELECT o, s FROM flnk WHERE s <> o)",
        "freach(a, b) AS (SELECT a, b FROM fund UNION "
        "SELECT r.a, u.b FROM freach r JOIN fund u ON r.b = u.a)",
        "fcl AS (SELECT member, id FROM (SELECT a AS member, min(b) AS id FROM "
        "(SELECT a, b FROM freach UNION SELECT a, a FROM fund) GROUP BY a) c WHERE member <> id)",
    )


def _single(rule_sql: str) -> str:
    return _prelude() + f"\nSELECT DISTINCT s, p, o FROM ({rule_sql}) q"


def _rdfs_candidates() -> list[str]:
    return [
        f"SELECT x.s, '{TYPE}' AS p, d.o FROM abox x JOIN dom d ON x.p = d.s",
        f"SELECT x.o, '{TYPE}', r.o FROM abox x JOIN rng r ON x.p = r.s",
        "SELECT x.s, sp.o, x.o FROM abox x JOIN sp ON x.p = sp.s",
        f"SELECT x.s, '{TYPE}', c.o FROM abox x JOIN sc c ON x.p = '{TYPE}' AND x.o = c.s",
    ]


def _rdfs_one_pass() -> str:
    return f"""
r7 AS (SELECT x.s, sp.o AS p, x.o FROM abox x JOIN sp ON x.p = sp.s),
inst AS (SELECT s, p, o FROM abox UNION ALL SELECT s, p, o FROM r7),
r3 AS (SELECT x.o AS s, '{TYPE}' AS p, r.o FROM inst x JOIN rng r ON x.p = r.s),
r2 AS (SELECT x.s, '{TYPE}' AS p, d.o FROM inst x JOIN dom d ON x.p = d.s),
typ AS (SELECT s, o FROM inst WHERE p = '{TYPE}' UNION ALL SELECT s, o FROM r2
        UNION ALL SELECT s, o FROM r3),
r9 AS (SELECT t.s, '{TYPE}' AS p, c.o FROM typ t JOIN sc c ON t.o = c.s),
derived AS (SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r9
            UNION ALL SELECT * FROM r7)"""


def oracle_sql() -> dict[str, str]:
    P = _prelude()
    graph = "SELECT s, p, o FROM abox UNION SELECT s, p, o FROM tbox"
    kinds = " UNION ALL ".join(
        f"SELECT '{c}' AS kind, prop FROM ({_kind(c)}) k" for c in V.PROPERTY_CLASSES)
    restr = " UNION ALL ".join(
        f"SELECT '{k}' AS kind, v, prop, filler FROM ({_restr(pred)}) r"
        for k, pred in V.RESTRICTION_KINDS.items())
    cl = _with(*_clusters_ctes())
    rounds = _with(*_owl_rounds())
    last = f"f{OWL_ROUNDS}"
    trounds = _with(*_owl_rounds(transitive=True))
    fcl = _with(*_clusters_over(last))
    clustered = P + rounds + fcl + f"""
SELECT s, p, o FROM {last}
UNION SELECT member, '{SAME}', id FROM fcl
UNION SELECT coalesce(a.id, t.s), t.p, coalesce(b.id, t.o) FROM {last} t
  LEFT JOIN fcl a ON a.member = t.s LEFT JOIN fcl b ON b.member = t.o WHERE t.p <> '{SAME}'"""
    return {
        "normalise_vocab": P + f"\n{graph}",
        "split_tbox": P + f"\nSELECT * FROM ({graph}) g WHERE {IS_SCHEMA}",
        "split_abox": P + f"\nSELECT * FROM ({graph}) g WHERE NOT ({IS_SCHEMA})",
        "split_abox_parts": P + f"""
SELECT CASE WHEN p = '{TYPE}' THEN 'type' WHEN p = '{SAME}' THEN 'sameAs' ELSE 'triple' END AS part, s, p, o
FROM (SELECT s, p, o FROM abox UNION ALL SELECT DISTINCT s, p, o FROM ({_links_ifp('abox')}) l) t""",
        "parse_tokens": "SELECT '<o' || o_orderkey || '>' AS s, '<prio>' AS p, "
        "string_split(o_orderpriority, ' ')[1] AS o FROM orders "
        "WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'",
        "rejects": "SELECT CASE WHEN o_orderstatus = 'P' THEN '<o' || o_orderkey || '> <p>' "
        "ELSE '<o' || o_orderkey || '>  <gap>' END AS value FROM orders "
        "WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'",
        "parse_nt": "SELECT '<d' || doc_id || '>' AS s, '<text>' AS p, '\"' || "
        "regexp_replace(text, '[\\s\\x0B\\\\]+', ' ', 'g') || '\"' AS o FROM documents WHERE text IS NOT NULL",
        "sink_round_trip": P + "\nSELECT 'ex:doc' || doc_id AS s, 'ex:text of' AS p, text AS o "
        "FROM documents WHERE text <> '' UNION ALL SELECT s, p, o FROM tbox",
        "nt_terms": "SELECT 'blank' AS s_kind, 'd' || doc_id AS s, 'iri' AS p_kind, 'ex:text' AS p, 'literal' AS kind, "
        "text || chr(128512) AS value, CASE WHEN doc_id % 3 = 0 THEN lower(lang) END AS lang, "
        "CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN '<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString>' "
        "WHEN doc_id % 3 = 2 THEN '<ex:note>' ELSE '<http://www.w3.org/2001/XMLSchema#string>' END AS datatype "
        "FROM documents WHERE text IS NOT NULL",
        "load_graph": P + "\nSELECT s, p, o FROM abox UNION ALL SELECT s, p, o FROM tbox",
        "property_kinds": P + f"\n{kinds}",
        "inverse_pairs": P + "\nSELECT prop, inv FROM inv",
        "restrictions": P + f"\n{restr}",
        "rdfs2": _single(f"SELECT x.s, '{TYPE}' AS p, d.o FROM abox x JOIN dom d ON x.p = d.s"),
        "rdfs3": _single(f"SELECT x.o AS s, '{TYPE}' AS p, r.o FROM abox x JOIN rng r ON x.p = r.s"),
        "rdfs5": P + f"\nSELECT s, '{V.RDFS_SUBPROPERTY_OF}' AS p, o FROM sp",
        "rdfs7": _single("SELECT x.s, sp.o AS p, x.o FROM abox x JOIN sp ON x.p = sp.s"),
        "rdfs9": _single(f"SELECT x.s, '{TYPE}' AS p, c.o FROM abox x JOIN sc c "
                         f"ON x.p = '{TYPE}' AND x.o = c.s"),
        "rdfs11": P + f"\nSELECT s, '{V.RDFS_SUBCLASS_OF}' AS p, o FROM sc",
        "new_facts": P + "\nSELECT DISTINCT s, p, o FROM ("
        + " UNION ALL ".join(_rdfs_candidates()) + ") c "
        "WHERE NOT EXISTS (SELECT 1 FROM abox a WHERE a.s = c.s AND a.p = c.p AND a.o = c.o)",
        "owl1": _single(_links_fp("abox")),
        "owl2": _single(_links_ifp("abox")),
        "owl3": _single("SELECT o AS s, p, s AS o FROM abox WHERE p IN (SELECT prop FROM sym)"),
        "owl4": P + _with(
            "te AS (SELECT DISTINCT s, p, o FROM abox WHERE p IN (SELECT prop FROM trp))",
            "tc(s, p, o) AS (SELECT s, p, o FROM te UNION "
            "SELECT c.s, c.p, e.o FROM tc c JOIN te e ON c.p = e.p AND c.o = e.s)",
        ) + "\nSELECT s, p, o FROM tc",
        "owl4_compact": P + _with(
            "te AS (SELECT DISTINCT s, p, o FROM abox WHERE p IN (SELECT prop FROM trp))",
            "tc(s, p, o) AS (SELECT s, p, o FROM te UNION "
            "SELECT c.s, c.p, e.o FROM tc c JOIN te e ON c.p = e.p AND c.o = e.s)",
            "want AS (SELECT conv_id c, turn a, unnest([0, turn - 2, NULL]) b FROM conversations "
            "UNION ALL SELECT conv_id, 0, turn FROM conversations UNION ALL SELECT conv_id, turn, turn FROM conversations)",
        ) + "\nSELECT s, p, o FROM tc WHERE (p, s, o) IN (SELECT 'ex:replyTo', 'ex:conv' || c || '_' || a, "
        "'ex:conv' || c || '_' || b FROM want WHERE b IS NOT NULL)",
        "owl7_clusters": P + cl + "\nSELECT member, id FROM cl",
        "cluster_members": P + cl + "\nSELECT id, n // 1000 AS page, any_value(k) AS n_members, any_value(z) AS max_member, "
        "string_agg(member, ' ' ORDER BY member) AS members FROM (SELECT id, member, row_number() OVER (PARTITION BY id "
        "ORDER BY member) - 1 AS n, count(*) OVER (PARTITION BY id) AS k, max(member) OVER (PARTITION BY id) AS z FROM "
        "(SELECT member, id FROM cl UNION ALL SELECT DISTINCT id, id FROM cl) m) r GROUP BY id, n // 1000",
        "cluster_pages": P + cl + "\nSELECT id, n // 2 AS page, string_agg(member, ' ' ORDER BY member) AS members FROM ("
        "SELECT id, member, row_number() OVER (PARTITION BY id ORDER BY member) - 1 AS n FROM "
        "(SELECT member, id FROM cl UNION ALL SELECT DISTINCT id, id FROM cl) m) r GROUP BY id, n // 2",
        "owl8": _single("SELECT x.o AS s, i.inv AS p, x.s AS o FROM abox x JOIN inv i ON x.p = i.prop"),
        "owl11": P + cl + f""", mem AS (SELECT member, id FROM cl UNION SELECT id, id FROM cl),
can AS (SELECT DISTINCT coalesce(a.id, t.s) AS s, t.p, coalesce(b.id, t.o) AS o FROM abox t
  LEFT JOIN cl a ON a.member = t.s LEFT JOIN cl b ON b.member = t.o WHERE t.p <> '{SAME}')
SELECT coalesce(a.member, c.s) AS s, c.p, coalesce(b.member, c.o) AS o FROM can c
  LEFT JOIN mem a ON a.id = c.s LEFT JOIN mem b ON b.id = c.o""",
        "owl11_expanded": P + cl + """, mem AS (SELECT member, id FROM cl UNION SELECT id, id FROM cl),
can AS (SELECT DISTINCT coalesce(a.id, t.s) AS s, t.p, coalesce(b.id, t.o) AS o FROM abox t
  LEFT JOIN cl a ON a.member = t.s LEFT JOIN cl b ON b.member = t.o WHERE t.p = 'ex:textHash')
SELECT coalesce(a.member, c.s) AS s, c.p, coalesce(b.member, c.o) AS o FROM can c
  LEFT JOIN mem a ON a.id = c.s LEFT JOIN mem b ON b.id = c.o""",
        "owl14a": _single(f"SELECT x.s, '{TYPE}' AS p, h.v AS o FROM abox x "
                          "JOIN hv h ON x.p = h.prop AND x.o = h.filler"),
        "owl14b": _single("SELECT x.s, h.prop AS p, h.filler AS o FROM abox x "
                          f"JOIN hv h ON x.p = '{TYPE}' AND x.o = h.v"),
        "owl15": _single(f"SELECT e.s, '{TYPE}' AS p, r.v AS o FROM abox e JOIN svf r ON e.p = r.prop "
                         f"JOIN abox t ON t.p = '{TYPE}' AND t.s = e.o AND t.o = r.filler"),
        "owl16": _single(f"SELECT e.o AS s, '{TYPE}' AS p, r.filler AS o FROM abox e "
                         f"JOIN avf r ON e.p = r.prop "
                         f"JOIN abox t ON t.p = '{TYPE}' AND t.s = e.s AND t.o = r.v"),
        "materialize_rdfs_derived": P + "," + _rdfs_one_pass() + "\nSELECT DISTINCT * FROM derived",
        "materialize_rdfs_all": P + "," + _rdfs_one_pass()
        + "\nSELECT * FROM derived UNION SELECT s, p, o FROM abox",
        "materialize_rdfs_schema": P + f"""
SELECT s, p, o FROM tbox WHERE {IS_SCHEMA}
UNION SELECT s, '{V.RDFS_SUBCLASS_OF}', o FROM sc
UNION SELECT s, '{V.RDFS_SUBPROPERTY_OF}', o FROM sp""",
        "materialize_owl": P + rounds + f"\nSELECT s, p, o FROM {last} UNION {_links(last)}",
        "materialize_owl_batch": P + rounds + f"\nSELECT s, p, o FROM {last} UNION {_links(last)}",
        "owl7_links": P + cl + f"\nSELECT member AS s, '{SAME}' AS p, id AS o FROM cl",
        "materialize_owl_transitive": P + trounds + f"\nSELECT s, p, o FROM {last} UNION {_links(last)}",
        "materialize_owl_clusters": clustered,
        "materialize_owl_encoded": clustered,
        "materialize_owl_merged": _prelude(ABOX_RAW + " union all " + MERGE_ABOX, AXIOMS + MERGE_AXIOMS)
        + _with(*_merged_rounds()) + f"""
SELECT s, p, o FROM m{MERGE_ROUNDS} WHERE p <> '{SAME}'
UNION ALL SELECT member, '{SAME}', id FROM q{MERGE_ROUNDS}""",
        "materialize_owl_schema": P + f"""
SELECT s, p, o FROM tbox WHERE {IS_SCHEMA}
UNION SELECT s, '{V.RDFS_SUBCLASS_OF}', o FROM sc
UNION SELECT s, '{V.RDFS_SUBPROPERTY_OF}', o FROM sp
UNION SELECT prop, '{V.OWL_INVERSE_OF}', inv FROM inv""",
    }
