"""Registered text queries: substring search over part and documents (Q4, L4), sectioned lines (S4 parsing, W2
tabs, P14 comments) built from the conversations table, text scalars (F1, F2, F19, F23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import capitalize, clean_number, clean_text, trunc_decimal
from ..operators.groups import dictionary_pages
from ..operators.ranks import runs
from . import sqlparts as S
from ..operators.search import search
from ..operators.groups import dictionary_view
from ..sources.files import comments_for, ingest_dictionary, parse_sections, sheet_rows, stack_sheets
from ..sources.testdata import table

PART_QUERY = "green  bolt*"
DOC_QUERY = "thorre  eauaux ment"
DOC_TOP = 25


def search_parts(spark, sf):
    return search(table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"], PART_QUERY)


def search_documents(spark, sf):
    return search(table(spark, sf, "documents"), "doc_id", ["text"], DOC_QUERY, keep=["lang"])


def search_documents_top(spark, sf):
    return search(table(spark, sf, "documents"), "doc_id", ["text"], DOC_QUERY, limit=DOC_TOP, keep=["lang"])


def _section_lines(spark, sf):
    """Conversation turns written as tab lines 'conv<id>==<id>==<role>==<text>' (newlines joined with ' ')."""
    c = table(spark, sf, "conversations")
    line = F.concat_ws("==", F.concat(F.lit("conv"), F.col("conv_id").cast("string")), F.col("conv_id").cast("string"),
                       F.col("role"), F.regexp_replace(F.col("text"), "\n", " "))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), line.alias("value"))


def sections(spark, sf):
    """S4 parsing: header, order, style and the remainder of each line (the text may itself contain '==')."""
    p = parse_sections(_section_lines(spark, sf), 3, ["header", "order", "text_type", "text"])
    return p.select("line", "header", F.col("order").cast("int").alias("order"), "text_type",
                    F.length("text").alias("text_len"), F.md5("text").alias("text_md5"))


def tabs(spark, sf):
    """Lines ordered by (order, header, line), a new tab whenever the header changes; one row per tab."""
    p = parse_sections(_section_lines(spark, sf), 3, ["header", "order", "text_type", "text"]).withColumn(
        "order", F.col("order").cast("int"))
    # sorted over all tasks; runs that reach over a border are joined by a table of the borders
    g = runs(p, ["order", "header", "line"], "header", id_col="line", sums={
        "chars": F.length("text").cast("long"), "text_sum": F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")})
    return g.select("group_no", "header", F.col("n").alias("n_lines"), F.col("first_id").alias("first_line"), "chars",
                    "text_sum")


def comments(spark, sf):
    """Comment lines 'role==turn==text' of one location (the 'user' role), ordered by line."""
    c = table(spark, sf, "conversations")
    lines = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"),
                     F.concat_ws("==", "role", F.col("turn").cast("string"),
                                 F.regexp_replace("text", "\n", " ")).alias("value"))
    p = parse_sections(lines, 2, ["location", "line_no", "comment"])
    return comments_for(p, "user").select("line", "location", F.col("line_no").cast("int").alias("line_no"),
                                          F.length("comment").alias("comment_len"), F.md5("comment").alias("comment_md5"))


def text_scalars(spark, sf):
    """F1, F2, F19 on part names/types and F3 on prices."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        capitalize(F.col("p_name")).alias("cap_name"),
        clean_text(F.concat_ws("||", "p_name", "p_type")).alias("cleaned"),
        clean_number(F.concat(F.lit(" $"), F.format_number(F.col("p_retailprice"), 2), F.lit(" "))).alias("number"),
        trunc_decimal(F.col("p_size")).alias("size_text"),
        trunc_decimal(F.col("p_retailprice")).alias("price_text"),
    )


def _part_entries(spark, sf):
    """Q8 on the part table as stacked dictionary sheets: one entry per named part, category = type."""
    return ingest_dictionary(table(spark, sf, "part"), label="p_name", name="p_partkey", description="p_size",
                             values="p_brand", category="p_type", seq="p_partkey")


def data_dictionary(spark, sf):
    return _part_entries(spark, sf).select("id", "label", "variable", "values", "category",
                                           F.col("description").cast("string").alias("description"))


def dictionary_groups(spark, sf):
    """Q5: consecutive entries of one category, split by blocks of 1000 ids so no task holds every entry."""
    v = dictionary_view(_part_entries(spark, sf), bucket=F.floor(F.col("id") / 1000))
    return v.select("id", "name", F.size("data").alias("n"), F.array_join(F.transform("data", lambda d: F.concat_ws(
        "=", d["seq"].cast("string"), d["label"], d["category"], d["values"])), "|").alias("members"))


PAGE = 2  # rows of a dictionary page: small, so that the parts' runs fill more than one


def dictionary_in_pages(spark, sf):
    """Q5 in pages: lines of the orders table by priority as one long dictionary, its runs cut into pages."""
    o = table(spark, sf, "orders")
    entries = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"),
                       F.col("o_custkey").cast("string").alias("variable"), F.col("o_orderstatus").alias("category"),
                       F.lit(None).cast("string").alias("description"), F.col("o_orderdate").cast("string").alias("values"))
    v = dictionary_pages(entries, PAGE)
    return v.select("group_no", "id", "name", "page", F.size("data").alias("n"), F.array_join(F.transform(
        "data", lambda d: F.concat_ws("=", d["seq"].cast("string"), d["label"], d["category"], d["values"])), "|")
        .alias("members"))


def stacked_sheets(spark, sf):
    """S3: two sheets, the customers and the suppliers, columns kept by name in any case, the sheet name appended;
    customers carry their own sheet names (one per market segment), read in one pass."""
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier").toDF(*[x.replace("s_", "C_", 1) for x in table(spark, sf, "supplier").columns])
    keep = ["c_name", "C_ACCTBAL"]
    by_segment = sheet_rows(c, keep=keep, sheet=F.col("c_mktsegment"), sheet_col="Segment", drop_empty=True)
    suppliers = stack_sheets({"SUPPLIERS": s}, keep=keep, sheet_col="Segment", drop_empty=True)
    return by_segment.unionByName(suppliers)


QUERIES = {
    "stack_sheets": stacked_sheets,
    "data_dictionary": data_dictionary,
    "dictionary_view": dictionary_groups,
    "dictionary_pages": dictionary_in_pages,
    "search_parts": search_parts,
    "search_documents": search_documents,
    "search_documents_top": search_documents_top,
    "sections": sections,
    "tabs": tabs,
    "comments": comments,
    "scalar_text": text_scalars,
}


def _score_sql(cols, query):
    terms = [t.lower() for t in query.replace("*", "").split()]
    return " + ".join(f"(CASE WHEN contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '{t}') THEN 1 ELSE 0 END)"
                      for c in cols for t in terms)


_LINES = """_lines AS (
  SELECT conv_id * 1000 + turn AS line,
         concat_ws('==', 'conv' || CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), role,
                   replace(text, chr(10), ' ')) AS value
  FROM conversations
),
_kept AS (SELECT line, trim(value) AS value FROM _lines WHERE length(trim(value)) > 0 AND NOT prefix(trim(value), '#')),
_parsed AS (
  SELECT line, split_part(value, '==', 1) AS header, CAST(split_part(value, '==', 2) AS INTEGER) AS "order",
         split_part(value, '==', 3) AS text_type,
         """ + S.clean_text("""CASE WHEN length(value) - length(replace(value, '==', '')) >= 6
              THEN substr(value, length(split_part(value, '==', 1)) + length(split_part(value, '==', 2))
                                 + length(split_part(value, '==', 3)) + 7)
              ELSE '' END""") + """ AS text
  FROM _kept
)"""

SQL = {
    "stack_sheets": """SELECT c_name, c_acctbal AS "C_ACCTBAL", c_mktsegment AS "Segment" FROM customer
WHERE c_name <> '' OR c_acctbal IS NOT NULL
UNION ALL SELECT s_name, s_acctbal, 'SUPPLIERS' FROM supplier WHERE s_name <> '' OR s_acctbal IS NOT NULL""",
    "data_dictionary": """SELECT p_partkey AS id, p_name AS label, CAST(p_partkey AS VARCHAR) AS variable,
  p_brand AS "values", p_type AS category, CAST(p_size AS VARCHAR) AS description
FROM part WHERE p_partkey IS NOT NULL""",
    "dictionary_view": """WITH g AS (
  SELECT *, sum(s) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT *, CASE WHEN lag(p_type) OVER (ORDER BY p_partkey) IS NOT DISTINCT FROM p_type
                    AND row_number() OVER (ORDER BY p_partkey) > 1 THEN 0 ELSE 1 END AS s
    FROM part WHERE p_partkey IS NOT NULL))
SELECT min(p_partkey) AS id, arg_min(p_type, p_partkey) AS name, CAST(count(*) AS INTEGER) AS n,
       string_agg(p_partkey || '=' || p_name || '=' || CAST(p_partkey AS VARCHAR) || '=' || p_brand, '|'
                  ORDER BY p_partkey) AS members
FROM g GROUP BY grp""",
    "search_parts": f"""SELECT p_partkey, p_name, p_type, {_score_sql(['p_name', 'p_type'], PART_QUERY)} AS score
FROM part WHERE {_score_sql(['p_name', 'p_type'], PART_QUERY)} > 0""",
    "search_documents": f"""SELECT doc_id, lang, {_score_sql(['text'], DOC_QUERY)} AS score
FROM documents WHERE {_score_sql(['text'], DOC_QUERY)} > 0""",
    "search_documents_top": f"""SELECT doc_id, lang, {_score_sql(['text'], DOC_QUERY)} AS score
FROM documents WHERE {_score_sql(['text'], DOC_QUERY)} > 0 ORDER BY score DESC, doc_id LIMIT {DOC_TOP}""",
    "sections": f"""WITH {_LINES}
SELECT line, header, "order", text_type, CAST(length(text) AS INTEGER) AS text_len, md5(text) AS text_md5 FROM _parsed""",
    "tabs": f"""WITH {_LINES},
_g AS (SELECT *, sum(s) OVER (ORDER BY "order", header, line ROWS UNBOUNDED PRECEDING) AS group_no FROM (
  SELECT *, CASE WHEN lag(header) OVER (ORDER BY "order", header, line) IS NOT DISTINCT FROM header
                  AND row_number() OVER (ORDER BY "order", header, line) > 1 THEN 0 ELSE 1 END AS s FROM _parsed))
SELECT CAST(group_no AS BIGINT) AS group_no, min(header) AS header, count(*) AS n_lines, min(line) AS first_line,
       CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT)) AS BIGINT) AS text_sum
FROM _g GROUP BY group_no""",
    "comments": """SELECT line, 'user' AS location, line_no, CAST(length(comment) AS INTEGER) AS comment_len,
  md5(comment) AS comment_md5
FROM (SELECT line, CAST(turn AS INTEGER) AS line_no, """ + S.clean_text("""CASE WHEN length(v) - length(replace(v, '==', '')) >= 4
    THEN substr(v, length(split_part(v, '==', 1)) + length(split_part(v, '==', 2)) + 5) ELSE '' END""") + """ AS comment
  FROM (SELECT conv_id * 1000 + turn AS line, turn, role,
               trim(concat_ws('==', role, CAST(turn AS VARCHAR), replace(text, chr(10), ' '))) AS v FROM conversations)
  WHERE role = 'user' AND length(v) > 0 AND NOT prefix(v, '#'))""",
    "dictionary_pages": f"""WITH g AS (
  SELECT *, sum(s) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT *, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) IS NOT DISTINCT FROM o_orderstatus
                    AND row_number() OVER (ORDER BY o_orderkey) > 1 THEN 0 ELSE 1 END AS s FROM orders)),
p AS (SELECT *, min(o_orderkey) OVER (PARTITION BY grp) AS id,
             (row_number() OVER (PARTITION BY grp ORDER BY o_orderkey) - 1) // {PAGE} AS page FROM g)
SELECT CAST(grp AS BIGINT) AS group_no, id, o_orderstatus AS name, page, CAST(count(*) AS INTEGER) AS n,
       string_agg(o_orderkey || '=' || o_orderpriority || '=' || o_custkey || '=' || o_orderdate, '|'
                  ORDER BY o_orderkey) AS members
FROM p GROUP BY grp, id, o_orderstatus, page""",
    "scalar_text": """SELECT p_partkey,
  upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS cap_name,
  replace(p_name || '||' || p_type, '||', chr(10)) AS cleaned,
  trim(replace(replace(' $' || format('{:,.2f}', p_retailprice) || ' ', ',', ''), '$', '')) AS number,
  CAST(p_size AS VARCHAR) AS size_text,
  regexp_replace(CAST(p_retailprice AS VARCHAR), '([.][0-9])[0-9]+$', '\\1') AS price_text
FROM part""",
}
