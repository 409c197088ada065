"""Queries that apply the operators to whole driver tables, each with its DuckDB equivalent where SQL can express it.

Where an operator's input isn't in the tables (CSV, fences, layouts, templates), the query builds it from columns.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import normalize_dates
from ..functions.text import cache_key, unfence, url_escaped
from ..operators import agents, chat, ocr, prompts, pseudonyms, tokens
from ..shared import numbered, shared_folder
from ..sources import chats, tables
from ..sources import documents as files
from ..sources.xlsx import read_xlsx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = bytes(range(32))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# tokenisation


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant_id"), F.lit("Account").alias("token_type"), F.col("c_name").alias("real"), "c_custkey")


_HASH = "upper(sha256(concat({t}, chr(1), 'account', chr(1), lower(trim({r})))))"
_C_HASH = _HASH.format(t="c_mktsegment", r="c_name")


@query(f"SELECT c_mktsegment AS tenant_id, c_name AS real, {_C_HASH} AS real_value_hash, 'ACCOUNT_' || lower(substr({_C_HASH}, 1, 12)) AS token FROM customer")
def tokenise_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenised(_accounts(spark, sf_dir)).select("tenant_id", "real", "real_value_hash", "token")


@query(
    f"SELECT c_mktsegment AS tenant_id, 'Account' AS token_type, 'ACCOUNT_' || lower(substr({_C_HASH}, 1, 12)) AS token, {_C_HASH} AS real_value_hash, c_name AS real "
    "FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer s WHERE s.c_custkey % 2 = 0 AND s.c_mktsegment = c.c_mktsegment AND lower(s.c_name) = lower(c.c_name))"
)
def register_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the customers are in the store; all are registered twice, once in other case and padded."""
    rows = _accounts(spark, sf_dir)
    store = tokens.tokenised(rows.where("c_custkey % 2 = 0")).select("tenant_id", "real_value_hash")
    again = rows.withColumn("real", F.concat(F.lit("  "), F.upper("real"), F.lit("\t"))).withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    return tokens.new_entries(tokens.tokenised(rows.unionByName(again)), store, "c_custkey")


@query(f"SELECT c_mktsegment AS tenant_id, c_name AS real, '{{}}_' || lower(substr(upper(sha256(concat(c_mktsegment, chr(1), 'partner', chr(1), lower(c_name)))), 1, 12)) AS token FROM customer".format("PARTNER"))
def register_last_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name registered as account, then as partner: the last type's token is shown."""
    rows = _accounts(spark, sf_dir).withColumn("at", F.col("c_custkey"))
    other = rows.withColumn("token_type", F.lit("Partner")).withColumn("at", F.col("at") + 1_000_000_000)
    return tokens.shown(tokens.tokenised(rows.unionByName(other)), "at")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenised(_accounts(spark, sf_dir))
    return rows.select("tenant_id", "token_type", "token", "real_value_hash", tokens.protect("real", KEY).alias("real_value_encrypted"))


@query(f"SELECT 'ACCOUNT_' || lower(substr({_C_HASH}, 1, 12)) AS token, c_name AS real FROM customer WHERE c_mktsegment = 'BUILDING'")
def reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tokens.tokenised(_accounts(spark, sf_dir)).select("token")
    asked = asked.unionByName(asked).unionByName(asked.select(F.concat("token", F.lit("0")).alias("token")))
    return tokens.reveal(asked, _store(spark, sf_dir), "BUILDING", KEY)


@query("SELECT c_name AS token, c_name AS real FROM customer WHERE false")
def reveal_wrong_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.reveal(tokens.tokenised(_accounts(spark, sf_dir)), _store(spark, sf_dir), "another", KEY)


@query("SELECT s_suppkey, s_name AS real, true AS hidden FROM supplier")
def protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = _table(spark, sf_dir, "supplier").withColumn("sealed", tokens.protect("s_name", KEY))
    return sealed.select("s_suppkey", tokens.unprotect("sealed", KEY).alias("real"), (~F.contains("sealed", "s_name")).alias("hidden"))


@query(
    f"SELECT c_mktsegment AS tenant_id, 'Account' AS token_type, 'ACCOUNT_' || lower(substr({_C_HASH}, 1, 12)) AS token, {_C_HASH} AS real_value_hash, c_name AS real, true AS hidden FROM customer "
    "UNION ALL SELECT '', 'Vendor', 'VENDOR_' || lower(substr({h}, 1, 12)), {h}, s_name, true FROM supplier".format(h="upper(sha256(concat('', chr(1), 'vendor', chr(1), lower(trim(s_name)))))")
)
def key_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and, without tenant, suppliers, registered twice into a written store among blank values; the store read back."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = _accounts(spark, sf_dir).withColumnRenamed("c_custkey", "at")
    vendors = _table(spark, sf_dir, "supplier").select(F.lit(None).cast("string").alias("tenant_id"), F.lit("Vendor").alias("token_type"), F.col("s_name").alias("real"), (F.col("s_suppkey") + 10**9).alias("at"))
    blank = rows.withColumn("real", F.when(F.col("at") % 2 == 0, F.lit(" \t"))).withColumn("at", F.col("at") + 2 * 10**9)
    for given in (rows.unionByName(vendors).unionByName(blank), rows.unionByName(vendors).withColumn("real", F.concat(F.lit(" "), F.upper("real")))):
        tokens.register(given, path, tokens.Aes(KEY), "at").count()
    sealed = F.col("real_value_encrypted")
    return tokens.read_store(spark, path).select("tenant_id", "token_type", "token", "real_value_hash", tokens.unprotect(sealed, KEY).alias("real"), (~F.contains(sealed, F.col("token"))).alias("hidden"))


@query("SELECT n_nationkey, n_nationkey + 16 = 32 AS good FROM nation")
def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def good(n: int) -> bool:
        try:
            return bool(tokens.check_key(bytes(n)))
        except ValueError:
            return False

    keys = [r[0] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 nations
    return spark.createDataFrame([(k, good(k + 16)) for k in keys], "n_nationkey long, good boolean")


@query("SELECT p_partkey, url_encode(p_type || ' é/~*' || p_name) AS escaped, p_brand || chr(31) || chr(31) || CAST(p_partkey AS VARCHAR) AS key FROM part")
def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("p_type", F.lit(" é/~*"), "p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", url_escaped(said).alias("escaped"), cache_key("p_brand", F.lit(None), "p_partkey").alias("key"))


# pseudonyms


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, key, name, kind, add: _table(spark, sf_dir, t).select((F.col(key) + add).cast("long").alias("ordinal"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    named = one("customer", "c_custkey", "c_name", "account", 0).unionByName(one("supplier", "s_suppkey", "s_name", "vendor", 10**9)).unionByName(one("nation", "n_nationkey", "n_name", "partner", 2 * 10**9))
    again = named.withColumn("ordinal", F.col("ordinal") + 10**10).withColumn("name", F.concat(F.lit(" "), F.lower("name")))
    return named.unionByName(again)


_MAP = """
SELECT 'ACCOUNT' AS kind, c_name AS real, 'ACCOUNT_' || printf('%02d', row_number() OVER (ORDER BY c_custkey)) AS token FROM customer
UNION ALL SELECT 'VENDOR', s_name, 'VENDOR_' || printf('%02d', row_number() OVER (ORDER BY s_suppkey)) FROM supplier
UNION ALL SELECT 'PARTNER', n_name, 'PARTNER_' || printf('%02d', row_number() OVER (ORDER BY n_nationkey)) FROM nation"""


@query(_MAP)
def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.identity_map(_mentions(spark, sf_dir)).select("kind", "real", "token")


@query(f"SELECT count(*) AS identities FROM ({_MAP})")
def identity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.identity_count(pseudonyms.identity_map(_mentions(spark, sf_dir)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'ACCOUNT_' || printf('%02d', row_number() OVER (ORDER BY c_custkey)) END AS token FROM customer")
def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(" \t")).otherwise(F.upper("c_name")).alias("name"))
    return pseudonyms.anonymize(rows, pseudonyms.identity_map(_mentions(spark, sf_dir)), "account", "name", "token").select("c_custkey", "token")


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, key, name, kind, add: _table(spark, sf_dir, t).select((F.col(key) + add).cast("long").alias("ordinal"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return pseudonyms.identity_map(one("supplier", "s_suppkey", "s_name", "account", 0).unionByName(one("nation", "n_nationkey", "n_name", "partner", 10**9)))


_NAMES = """
names AS (
  SELECT 1 AS k, row_number() OVER (ORDER BY s_suppkey) AS n, s_name AS real, 'ACCOUNT_' || printf('%02d', row_number() OVER (ORDER BY s_suppkey)) AS token FROM supplier
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n_nationkey), n_name, 'PARTNER_' || printf('%02d', row_number() OVER (ORDER BY n_nationkey)) FROM nation),
said AS (SELECT s_suppkey, 'Ship ' || upper(s_name) || ' to ' || lower(n_name) || ' (' || s_name || ')' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", F.concat(F.lit("Ship "), F.upper("s_name"), F.lit(" to "), F.lower("n_name"), F.lit(" ("), F.col("s_name"), F.lit(")")).alias("text"))


_SCRUBBED = """list_reduce(list_prepend({'real': '', 'token': text}, (SELECT list({'real': real, 'token': token} ORDER BY k, n) FROM names WHERE length(real) >= 4)),
  lambda acc, x: {'real': '', 'token': regexp_replace(acc.token, '(?i)' || regexp_escape(x.real), x.token, 'g')}).token"""


@query(f"WITH {_NAMES} SELECT s_suppkey, {_SCRUBBED} AS scrubbed FROM said")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.scrub(_said(spark, sf_dir), _session(spark, sf_dir), "text", "scrubbed").select("s_suppkey", "scrubbed")


@query(
    f"WITH {_NAMES} SELECT s_suppkey, list_reduce(list_prepend({{'token': '', 'real': {_SCRUBBED}}}, (SELECT list({{'token': token, 'real': real}} ORDER BY k, n) FROM names)), "
    "lambda acc, x: {'token': '', 'real': replace(acc.real, x.token, x.real)}).real AS hydrated FROM said"
)
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark, sf_dir)
    scrubbed = pseudonyms.scrub(_said(spark, sf_dir), session, "text", "scrubbed")
    return pseudonyms.hydrate(scrubbed, session, "scrubbed", "hydrated").select("s_suppkey", "hydrated")


# dates

@query(
    r"""WITH shaped AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 AS k,
    CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:00' WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') || 'T10' WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 3 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 5 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) WHEN 6 THEN strftime(o_orderdate, '%Y-%d-%m') WHEN 7 THEN '0001-01-01' ELSE ' ' END AS s,
    ['TBD', ' - ', NULL, '2001-01-01', 'On-going'][CAST(o_orderkey % 5 + 1 AS INT)] AS e FROM orders),
tok AS (SELECT *, regexp_extract(trim(s), '^[^ T]*') AS t FROM shaped),
parsed AS (
  SELECT *, coalesce(
    CASE WHEN regexp_matches(t, '^[0-9]+$') AND try_cast(t AS INT) BETWEEN 1 AND 59999 THEN DATE '1899-12-30' + CAST(t AS INT) END,
    CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN CAST(try_strptime(t, '%Y-%m-%d') AS DATE) END,
    CASE WHEN regexp_matches(t, '^\d{4}/\d{2}/\d{2}$') THEN CAST(try_strptime(t, '%Y/%m/%d') AS DATE) END,
    CASE WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}$') THEN CAST(try_strptime(t, '%m/%d/%Y') AS DATE) END,
    CASE WHEN regexp_matches(t, '^\d{2}/\d{2}/\d{4}$') THEN CAST(try_strptime(t, '%d/%m/%Y') AS DATE) END) AS p FROM tok)
SELECT o_orderkey, CASE WHEN year(p) BETWEEN 1990 AND 2100 THEN p END AS start, coalesce(lower(trim(e)), '') IN ('', '-', 'on-going', 'ongoing', 'tbd', 'current', 'present') AS is_active,
  CASE WHEN year(p) BETWEEN 1990 AND 2100 THEN NULL ELSE 'date_invalid' END AS flag FROM parsed"""
)
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp_ntz")
    form = lambda p: F.date_format(d, p)
    k = F.col("o_orderkey") % 9
    shaped = (
        F.when(k == 0, F.concat(form("yyyy-MM-dd"), F.lit(" 10:00"))).when(k == 1, F.concat(form("yyyy/MM/dd"), F.lit("T10"))).when(k == 2, form("MM/dd/yyyy")).when(k == 3, form("M/d/yyyy"))
        .when(k == 4, form("dd/MM/yyyy")).when(k == 5, F.datediff(d.cast("date"), F.lit("1899-12-30").cast("date")).cast("string")).when(k == 6, form("yyyy-dd-MM")).when(k == 7, "0001-01-01").otherwise(" ")
    )
    ends = F.get(F.array(F.lit("TBD"), F.lit(" - "), F.lit(None), F.lit("2001-01-01"), F.lit("On-going")), (F.col("o_orderkey") % 5).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", normalize_dates(shaped, ends).alias("n")).select("o_orderkey", "n.*")


# tables


def _record(key: str = "p_partkey") -> F.Column:
    return F.concat(F.lit('"'), F.col("p_name"), F.lit('\x01\x02, "" large"  , '), F.col("p_brand"), F.lit(' ,"'), F.col("p_type"), F.lit(' "",x",'), F.col(key).cast("string"))


@query("SELECT p_partkey, trim(p_name || chr(1) || chr(2) || ',  large') AS c1, p_brand AS c2, p_type || ' ,x' AS c3, CAST(p_partkey AS VARCHAR) AS c4, CAST(4 AS INTEGER) AS n FROM part")
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table(spark, sf_dir, "part").select("p_partkey", tables.split_csv(_record()).alias("c"))
    return cells.select("p_partkey", *[F.get("c", F.lit(i)).alias(f"c{i + 1}") for i in range(4)], F.size("c").alias("n"))


@query(
    "SELECT p_brand AS source, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS row_idx, trim(p_name) || chr(10) || 'and, more' AS name, p_type AS kind, "
    "CAST(4 * count(*) OVER (PARTITION BY p_brand) AS INTEGER) AS quotes FROM part"
)
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV text per brand, with line ends and commas within quotes."""
    line = F.concat(F.lit('"'), F.col("p_name"), F.lit('\r\nand, more","'), F.col("p_type"), F.lit('"'))
    texts = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))["line"], "\n").alias("text"))
    rows = tables.read_csv_text(texts.withColumnRenamed("p_brand", "source"))
    quotes = texts.select(F.col("p_brand").alias("source"), tables.quote_count("text").cast("int").alias("quotes"))
    return rows.join(quotes, "source").select("source", "row_idx", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("kind"), "quotes")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows per region: a banner, a header, ragged rows of nations, blank rows."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("source"), "n_nationkey", "n_name")
    body = n.select("source", (F.col("n_nationkey") * 2 + 10).cast("long").alias("row_idx"), F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).otherwise(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit(""))).alias("cells"))
    blank = n.select("source", (F.col("n_nationkey") * 2 + 11).cast("long").alias("row_idx"), F.array(F.lit(""), F.lit("")).alias("cells"))
    sources = n.select("source").distinct()
    head = sources.select("source", F.lit(0).cast("long").alias("row_idx"), F.array(F.concat(F.lit("Report "), "source")).alias("cells"))
    names = F.when(F.col("source") == "4", F.array(F.lit("Customer"), F.lit("Key"), F.lit("Note"))).otherwise(F.array(F.lit("Engagement Description"), F.lit(" KEY "), F.lit("Note"), F.lit("key")))
    columns = sources.select("source", F.lit(1).cast("long").alias("row_idx"), names.alias("cells"))
    return head.unionByName(columns).unionByName(body).unionByName(blank)


_BODY = """
body AS (SELECT CAST(n_regionkey AS VARCHAR) AS source, CAST(n_nationkey * 2 + 10 AS BIGINT) AS row_idx, n_name, n_nationkey FROM nation)"""


@query(
    f"WITH {_BODY} SELECT source, row_idx, n_name AS first_cell, CASE WHEN source = '4' THEN 'Report 4' ELSE 'Engagement Description' END AS first_header FROM body "
    "UNION ALL SELECT '4', 1, 'Customer', 'Report 4' FROM region WHERE r_regionkey = 4"
)
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.with_header(_sheets(spark, sf_dir))
    return t.select("source", "row_idx", F.get("cells", F.lit(0)).alias("first_cell"), F.get("headers", F.lit(0)).alias("first_header"))


@query(
    f"WITH {_BODY} SELECT source, row_idx, CASE WHEN source = '4' THEN '' ELSE n_name END AS name, CASE WHEN source = '4' OR n_nationkey % 3 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS key, "
    "CASE WHEN source = '4' OR n_nationkey % 3 = 0 THEN CASE WHEN source = '4' THEN '' ELSE n_name END ELSE '' END AS note FROM body UNION ALL SELECT '4', 1, '', '', '' FROM region WHERE r_regionkey = 4"
)
def cell_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = {"name": ("Customer Name", "engagementdescription"), "key": ("key",), "note": ("Note", "Engagement description")}
    return tables.wide(tables.with_header(_sheets(spark, sf_dir)), aliases)


@query(f"WITH {_BODY} SELECT source, row_idx, source <> '4' AS has_key, false AS has_value FROM body UNION ALL SELECT '4', 1, false, false FROM region WHERE r_regionkey = 4")
def has_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.with_header(_sheets(spark, sf_dir))
    return t.select("source", "row_idx", tables.has_column("headers", "Value", "K e y").alias("has_key"), tables.has_column("headers", "Value").alias("has_value"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS source, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS row_idx, n_name AS deal, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def ocr_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation in a block of its own with the header repeated, and text around the blocks."""
    n = F.col("n_nationkey").cast("string")
    block = F.concat(F.lit("Intro | x |\n[Table]\n| Deal | Key |\n| --- | :-: |\n| "), F.col("n_name"), F.lit(" | "), n, F.lit(" |\nnoise\n [/TABLE] \n| out | side |"))
    texts = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("source")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", block.alias("b"))))["b"], "\n").alias("text"))
    return tables.wide(tables.with_header(tables.ocr_rows(texts)), {"deal": ("deal",), "key": ("KEY",)})


@query("SELECT r_name AS source, CAST(0 AS BIGINT) AS n_rows, true AS same_columns FROM region")
def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without rows: no headers and no rows, in the columns of any other table."""
    texts = _table(spark, sf_dir, "region").select(F.col("r_name").alias("source"), F.lit("").alias("text"))
    table = tables.with_header(tables.read_csv_text(texts))
    same = table.columns == tables.with_header(_sheets(spark, sf_dir)).columns
    counts = table.groupBy("source").agg(F.count("*").alias("n"))
    return texts.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), F.lit(same).alias("same_columns"))


def _books(spark: SparkSession, sf_dir: str) -> str:
    """A folder of one workbook per region: a banner sheet, and one with a header and its nations."""
    folder = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    by: dict[int, list[tuple[int, str]]] = {}
    for r in _table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").collect():  # 25 nations
        by.setdefault(r[0], []).append((r[1], r[2]))
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    for region, nations in by.items():
        rows = f'<row r="2">{text("A2", "Deal")}{text("C2", "Key")}</row>'
        rows += "".join(f'<row r="{k}">{text(f"A{k}", name)}<c r="C{k}"><v>{n}</v></c></row><row/>' for k, (n, name) in enumerate(sorted(nations), 3))
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Cover" r:id="a"/><sheet name="Data" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="a.xml"/><Relationship Id="b" Target="b.xml"/></Relationships>',
            "xl/a.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
            "xl/b.xml": f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>',
        }
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, content in parts.items():
                z.writestr(name, content)
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{region}.xlsx") as f:
            f.write(data.getvalue())
    return folder


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, n_name AS deal, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second sheet of a workbook per region."""
    rows = tables.wide(tables.with_header(read_xlsx(spark, _books(spark, sf_dir), "data")), {"deal": ("deal",), "key": ("key",)})
    return rows.select(F.regexp_extract("source", r"(\d+)\.xlsx$", 1).alias("region"), "deal", "key")


def _layout_of(content: bytes) -> dict:
    """An analyzer: a page with the file's words, each second one unsure, and its lines; some files can't be read."""
    text = content.decode()
    if text.startswith("A"):
        raise ValueError("unreadable")
    words = [{"content": w, "confidence": 0.25 + 0.5 * (k % 2), "polygon": None} for k, w in enumerate(text.split())]
    return {"pages": [{"page_number": 1, "width": None, "height": None, "unit": None, "words": words, "lines": [{"content": line, "polygon": None} for line in text.splitlines()]}], "paragraphs": None, "tables": None}


@query(
    "SELECT n_regionkey AS region, plain, CASE WHEN lead LIKE 'A%' THEN plain ELSE masked END AS text, CAST(CASE WHEN lead LIKE 'A%' THEN 0 ELSE 1 END AS INTEGER) AS pages FROM ("
    "SELECT n_regionkey, min(n_name) AS lead, string_agg(replace(n_name, ' ', '_') || ' ' || n_nationkey || chr(10), '' ORDER BY n_name) AS plain, "
    "string_agg('[?] ' || n_nationkey, chr(10) ORDER BY n_name) AS masked FROM nation GROUP BY 1)"
)
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file per region with a line per nation, through the analyzer and without one."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    line = F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" "), F.col("n_nationkey").cast("string"))
    texts = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line"))))["line"], "\n").alias("value"))
    texts.write.partitionBy("n_regionkey").text(folder)
    region = F.regexp_extract("path", r"n_regionkey=(\d+)/", 1).cast("long").alias("region")
    source = f"{folder}/*/*.txt"
    plain = files.extract(spark, source).select(region, F.col("text").alias("plain"))
    return files.extract(spark, source, _layout_of).select(region, "text", F.size("pages").alias("pages")).join(plain, "region")


# layouts


def _words(text: F.Column) -> F.Column:
    parts = F.filter(F.split(text, " ", -1), lambda w: w != "")
    sure = lambda w, i: F.struct(F.lower(w).alias("content"), F.when((i % 5).isin(1, 2), F.lit(0.49)).otherwise(F.lit(0.5)).cast("float").alias("confidence"), F.array().cast("array<float>").alias("polygon"))
    return F.transform(parts, sure)


_PARTS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(
    f"""WITH said AS (SELECT conv_id, turn, text, {_PARTS} AS p FROM conversations),
marked AS (SELECT *, list_transform(p, lambda w, i: CASE WHEN (i - 1) % 5 IN (1, 2) THEN '[?]' ELSE w END) AS m FROM said)
SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN text ELSE
  list_aggregate(list_filter(m, lambda w, i: NOT (w = '[?]' AND i > 1 AND m[i - 1] = '[?]')), 'string_agg', ' ') END AS masked FROM marked"""
)
def ocr_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's words are the turn's own, so each is found in its place; the second and third of five are unsure."""
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ocr.masked("text", _words(F.col("text"))).alias("masked"))


@query("SELECT conv_id, turn, CASE WHEN length(replace(text, ' ', '')) = 0 THEN text ELSE '[SIGNATURE/HANDWRITING]' END AS masked FROM conversations")
def ocr_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.transform(_words(F.col("text")), lambda w: w.withField("confidence", F.lit(0.1).cast("float")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", ocr.masked("text", low).alias("masked"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region a grid with the region in row 0 and its nations below, sparse in the second column."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda r, c, x: F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), x.alias("content"))
    row = (F.col("n_nationkey") + 1) % 30
    per = n.groupBy("r_regionkey", "r_name").agg(
        F.array_sort(F.flatten(F.collect_list(F.array(cell(row, 0, F.concat(F.col("n_name"), F.lit("|x"))), cell(row, 0, F.lit("zzz second"))))), lambda a, b: F.when(a["content"] < b["content"], -1).when(a["content"] > b["content"], 1).otherwise(0)).alias("names"),
        F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, cell(row, 1, F.col("n_nationkey").cast("string")))).alias("keys"),
    )
    return per.select("r_regionkey", "r_name", F.concat(F.array(cell(F.lit(0), 0, F.col("r_name"))), "names", "keys").alias("cells"))


_GRID = r"""
rows AS (
  SELECT r_regionkey, r_name, s.r AS r, n.n_name, n.n_nationkey FROM region, (SELECT unnest(range(0, 31)) AS r) s LEFT JOIN nation n ON n.n_regionkey = r_regionkey AND n.n_nationkey + 1 = s.r),
top AS (SELECT n_regionkey, max(n_nationkey) + 1 AS last FROM nation GROUP BY 1),
lines AS (
  SELECT r_regionkey, r, CASE WHEN r = 0 THEN '| ' || r_name || ' |  |' || chr(10) || '| --- | --- |'
    ELSE '| ' || coalesce(n_name || '\|x', '') || ' | ' || coalesce(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END, '') || ' |' END AS line
  FROM rows JOIN top ON n_regionkey = r_regionkey WHERE r <= last),
drawn AS (SELECT r_regionkey, '[TABLE]' || chr(10) || string_agg(line, chr(10) ORDER BY r) || chr(10) || '[/TABLE]' AS markdown FROM lines GROUP BY 1)"""


@query(f"WITH {_GRID} SELECT r_regionkey, markdown FROM drawn")
def ocr_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("r_regionkey", ocr.table_markdown("cells").alias("markdown"))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation two pages whose lines are its turns and whose words its first turn's, each third unsure; odd conversations have a paragraph per turn, on both pages and an unknown one."""
    c = _table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    nothing = F.array().cast("array<float>")
    line = lambda s: F.struct(s["text"].alias("content"), nothing.alias("polygon"))
    tokens = F.filter(F.split(F.get("said", F.lit(0))["text"], " ", -1), lambda w: w != "")
    words = F.transform(tokens, lambda w, i: F.struct(w.alias("content"), F.when(i % 3 == 0, F.lit(0.25)).otherwise(F.lit(0.75)).cast("float").alias("confidence"), F.lit(None).cast("array<float>").alias("polygon")))
    page = lambda k, w, u: F.struct(F.lit(k).alias("page_number"), w.alias("width"), F.lit(None).cast("double").alias("height"), u.alias("unit"), words.alias("words"), F.transform("said", line).alias("lines"))
    pages = F.array(page(1, F.lit(8.5), F.lit("cm")), page(2, F.lit(None).cast("double"), F.lit(None).cast("string")))
    region = lambda k: F.struct(F.lit(k).alias("page_number"), F.array(F.lit(1.0).cast("float")).alias("polygon"))
    paragraphs = F.when(F.col("conv_id") % 2 == 1, F.transform("said", lambda s: F.struct(s["text"].alias("content"), F.array(region(2), region(1), region(9)).alias("bounding_regions"))))
    table = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("a|b").alias("content"))).alias("cells"))))
    return per.select("conv_id", F.struct(pages.alias("pages"), paragraphs.alias("paragraphs"), table.alias("tables")).cast(ocr.LAYOUT).alias("layout"))


_HIT = "CAST(coalesce(list_position(list_slice(words, a.at + 1, len(words)), lower(x.t)), 0) AS INTEGER)"


@query(
    f"""WITH words AS (SELECT conv_id, list_transform({_PARTS}, lambda w: lower(w)) AS words FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)),
folds AS (
  SELECT conv_id, turn, text, len(words) AS n, list_reduce(list_prepend({{'at': 0, 't': '', 'o': []::VARCHAR[]}}, list_transform({_PARTS}, lambda w: {{'at': 0, 't': w, 'o': []::VARCHAR[]}})),
    lambda a, x: {{'at': a.at + {_HIT}, 't': '', 'o': list_append(a.o, CASE WHEN {_HIT} > 0 AND (a.at + {_HIT} - 1) % 3 = 0 THEN '[?]' ELSE x.t END)}}).o AS o
  FROM conversations JOIN words USING (conv_id)),"""
    r"""
said AS (
  SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[\s\p{Z}]*$') THEN '' WHEN n = 0 THEN text WHEN len(list_filter(o, lambda w: w <> '[?]')) = 0 THEN '[SIGNATURE/HANDWRITING]'
    ELSE list_aggregate(list_filter(o, lambda w, i: NOT (w = '[?]' AND i > 1 AND o[i - 1] = '[?]')), 'string_agg', ' ') END AS t FROM folds),
joined AS (SELECT conv_id, string_agg(CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn) AS para,
  string_agg(CASE WHEN t <> '' THEN t || chr(10) ELSE '' END, '' ORDER BY turn) || chr(10) AS page FROM said GROUP BY 1)
SELECT conv_id, regexp_replace(CASE WHEN conv_id % 2 = 1 THEN para ELSE page || page END ||
  CASE WHEN conv_id % 3 = 0 THEN chr(10) || '[TABLE]' || chr(10) || '| a\|b |' || chr(10) || '| --- |' || chr(10) || '[/TABLE]' || chr(10) || chr(10) ELSE '' END, '[\s\p{Z}]+$', '') AS text FROM joined"""
)
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layouts(spark, sf_dir).select("conv_id", ocr.structured_text("layout").alias("text"))


@query(
    "SELECT conv_id, p AS page_number, CAST(CASE WHEN p = 1 THEN 8.5 ELSE 0.0 END AS DOUBLE) AS width, CAST(0 AS DOUBLE) AS height, CASE WHEN p = 1 THEN 'cm' ELSE 'inch' END AS unit, "
    f"array_to_string({_PARTS.replace('text', 'arg_min(text, turn)')}, ' ') AS words, string_agg(text, chr(31) ORDER BY turn) AS lines, CASE WHEN conv_id % 2 = 1 THEN string_agg(text, chr(31) ORDER BY turn) ELSE '' END AS paragraphs "
    "FROM conversations, (SELECT unnest([1, 2]) AS p) GROUP BY conv_id, p"
)
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _layouts(spark, sf_dir).select("conv_id", F.explode(ocr.page_data("layout")).alias("p"))
    return pages.select(
        "conv_id", "p.page_number", "p.width", "p.height", "p.unit", F.array_join("p.words.content", " ").alias("words"), F.array_join("p.lines.content", "\x1f").alias("lines"), F.array_join("p.paragraphs.content", "\x1f").alias("paragraphs"),
    )


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN html ELSE '' END AS text FROM pages")
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.get(F.array(*[F.lit(x) for x in ("/a.b/x.HTML", "y.md", "z.pdf", "no.txt/none")]), (F.col("page_id") % 4).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", files.fallback_text(ends, F.col("html").cast("binary")).alias("text"))


# chat

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    "SELECT conv_id, turn, CASE turn % 5 WHEN 4 THEN '   ' ELSE " + _TRIM.format("text") + " END AS bare FROM conversations"
)
def unfence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 5
    fenced = (
        F.when(k == 0, F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).when(k == 1, F.concat(F.lit("Here: ```json\n"), F.col("text"), F.lit("\n``` bye\n```x```")))
        .when(k == 2, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(k == 3, F.concat(F.lit("```json\n"), F.col("text"))).otherwise("   ")
    )
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", unfence(fenced).alias("bare"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    turn = F.struct(F.when(c["turn"] % 3 == 0, F.col("role")).when(c["turn"] % 3 == 1, "").alias("system"), F.col("text").alias("user"), (c["turn"] % 2 == 0).alias("json"), F.lit(0.2).alias("temperature"))
    return c.select("conv_id", "turn", chat.request_of_turn(turn).alias("r"))


@query(
    "SELECT conv_id, turn, 'm1' AS model, CASE WHEN turn % 3 = 0 THEN role END AS system, text AS user, CAST(0.2 AS DOUBLE) AS temperature, CASE WHEN turn % 2 = 0 THEN 'json_object' END AS format, "
    "CASE WHEN turn % 4 = 0 THEN CAST(99 AS INTEGER) END AS max_tokens FROM conversations"
)
def chat_body_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r")
    limit = F.when(F.col("turn") % 4 == 0, F.lit(99))
    body = chat.openai_body(r["user_prompt"], r["system_prompt"], r["model"], r["temperature"], r["json_response"], limit, "m1")
    shape = "model string, messages array<struct<role:string,content:string>>, temperature double, response_format struct<type:string>, max_tokens int"
    b = _turns(spark, sf_dir).select("conv_id", "turn", F.from_json(body, shape).alias("b"))
    said = lambda role: F.get(F.filter("b.messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return b.select("conv_id", "turn", "b.model", said("system").alias("system"), said("user").alias("user"), "b.temperature", F.col("b.response_format.type").alias("format"), "b.max_tokens")


@query(
    "SELECT conv_id, turn, 'm2' AS model, CASE WHEN turn % 3 = 0 THEN role END AS system, text AS user, CAST(1 AS INTEGER) AS n_messages, CASE WHEN turn % 4 = 0 THEN CAST(99 AS INTEGER) ELSE CAST(1024 AS INTEGER) END AS max_tokens FROM conversations"
)
def chat_body_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r")
    body = chat.anthropic_body(r["user_prompt"], r["system_prompt"], r["model"], r["temperature"], F.when(F.col("turn") % 4 == 0, F.lit(99)), "m2")
    shape = "model string, messages array<struct<role:string,content:string>>, system string, max_tokens int"
    b = _turns(spark, sf_dir).select("conv_id", "turn", F.from_json(body, shape).alias("b"))
    return b.select("conv_id", "turn", "b.model", "b.system", F.get("b.messages", F.lit(0))["content"].alias("user"), F.size("b.messages").alias("n_messages"), "b.max_tokens")


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || text ELSE '' END AS content FROM conversations")
def extract_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 5
    wrap = lambda c: F.concat(F.lit('{"choices": [{"message": {"content": '), c, F.lit("}}]}"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    parts = F.concat(F.lit('[{"text": '), quoted, F.lit('}, {"n": 1}, {"text": 5}, {"text": '), quoted, F.lit("}]"))
    answer = F.when(k == 0, wrap(quoted)).when(k == 1, wrap(parts)).when(k == 2, wrap(F.lit("null"))).when(k == 3, F.lit('{"choices": []}')).otherwise(F.lit('{"error": 1}'))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.openai_content(answer).alias("content"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || text ELSE '' END AS content FROM conversations")
def extract_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    parts = F.concat(F.lit('{"content": [{"type": "text", "text": '), quoted, F.lit('}, {"type": "tool"}, {"text": 7}, {"text": '), quoted, F.lit("}]}"))
    answer = F.when(k == 0, parts).when(k == 1, F.lit('{"content": "x"}')).otherwise(F.lit("{}"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.anthropic_content(answer).alias("content"))


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'anthropic' ELSE 'openai' END AS provider FROM events"
)
def route_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.get(F.array(F.lit(None), F.lit("ANTHROPIC"), F.lit(" "), F.col("event_type"), F.lit(" anthropic")), (F.col("event_id") % 5).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", chat.provider(keys).alias("provider"))


def _post(path: str, body: str) -> tuple[int, str]:
    """An endpoint of either shape that says the model and the text again."""
    b = json.loads(body)
    said = f"{b['model']}:{b['messages'][-1]['content']}!"
    parts = [{"text": said[:3]}, {"type": "other"}, {"text": said[3:]}]
    return (200, json.dumps({"choices": [{"message": {"content": parts}}]})) if path == "chat/completions" else (201, json.dumps({"content": parts}))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'm1:' ELSE 'own:' END || text || '!' AS content FROM conversations")
def chat_completed_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, none = F.when(F.col("turn") % 2 == 1, "own"), F.lit(None)
    body = chat.openai_body(F.col("text"), none.cast("string"), model, F.lit(0.0), F.lit(False), none.cast("int"), "m1")
    return chats.completed(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), body, _post).select("conv_id", "turn", "content")


@query("SELECT conv_id, turn, 'm2:' || text || '!' AS content FROM conversations")
def chat_completed_anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    body = chat.anthropic_body(F.col("text"), F.col("role"), none.cast("string"), F.lit(0.0), none.cast("int"), "m2")
    return chats.completed(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role"), body, _post, chat.ANTHROPIC).select("conv_id", "turn", "content")


class _Routed(agents.Agent):
    """A turn's text through the registry, by the event-like key of its row."""

    key = "routed"

    def build_user(self, row: dict) -> str:
        return f"{row['key'] or ''}|{row['text']}"

    def parse(self, raw: str) -> str:
        return raw

    def on_failure(self) -> str:
        return "failed"


def _routed_chat(turn: dict) -> str:
    registry = agents.ProviderRegistry({"openai": chats.OpenAiShape(_post, chat.LlmOptions(model_id="mo")), "anthropic": chats.AnthropicShape(_post, chat.AnthropicOptions(model_id="ma"))}, "openai")
    key, text = turn["user"].split("|", 1)
    return registry.complete({"provider_key": key, "user_prompt": text, "system_prompt": turn["system"]})


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'ma:' ELSE 'mo:' END || text || '!' AS result FROM conversations")
def chat_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.get(F.array(F.lit(None), F.lit("Anthropic"), F.lit("nobody")), (F.col("turn") % 3).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", keys.alias("key"))
    return _Routed().run(rows, _routed_chat).select("conv_id", "turn", "result")


# prompts

_TEMPLATES = """
templates AS (
  SELECT CAST(p_partkey AS BIGINT) AS prompt_template_id, p_type AS prompt_key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 4 AS INTEGER) END AS client_id,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS prompt_text, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS model_id, p_partkey % 5 <> 0 AS is_active,
    CAST(row_number() OVER (PARTITION BY p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 END ORDER BY p_partkey) AS INTEGER) AS version, p_partkey % 2 = 1 AS include_in_quality_analysis FROM part),
act AS (
  SELECT prompt_key, client_id, arg_max({'t': prompt_text, 'm': model_id}, version) AS best, max(version) AS version FROM templates WHERE is_active GROUP BY 1, 2)"""


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("p_partkey")
    client = F.when(k % 3 != 0, (k % 4).cast("int"))
    version = F.row_number().over(Window.partitionBy("p_type", client).orderBy(k))
    null = lambda t: F.lit(None).cast(t)
    t = _table(spark, sf_dir, "part").select(
        k.cast("long").alias("prompt_template_id"), F.col("p_type").alias("prompt_key"), client.alias("client_id"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("prompt_text"),
        F.when(k % 2 == 0, F.col("p_brand")).alias("model_id"), null("string").alias("description"), (k % 5 != 0).alias("is_active"), version.alias("version"), null("string").alias("change_summary"),
        (k % 2 == 1).alias("include_in_quality_analysis"), F.lit(False).alias("include_in_optimizer"), null("timestamp").alias("created_at"), null("timestamp").alias("updated_at"),
    )
    return spark.createDataFrame([], prompts.SCHEMA).unionByName(t)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "part").select(F.col("p_type").alias("prompt_key")).distinct().unionByName(spark.createDataFrame([("none such",)], "prompt_key string"))
    return keys.select("prompt_key", F.explode(F.array(F.lit(None).cast("int"), *[F.lit(i) for i in range(5)])).alias("client_id"))


_RESOLVED = """
asked AS (SELECT prompt_key, c AS client_id FROM (SELECT DISTINCT p_type AS prompt_key FROM part UNION ALL SELECT 'none such'), (SELECT unnest([NULL, 0, 1, 2, 3, 4]) AS c)),
found AS (
  SELECT r.prompt_key, r.client_id, coalesce(o.best.t, g.best.t, '') AS text, coalesce(o.best.m, g.best.m) AS model FROM asked r
  LEFT JOIN act o ON o.prompt_key = r.prompt_key AND o.client_id = r.client_id LEFT JOIN act g ON g.prompt_key = r.prompt_key AND g.client_id IS NULL)"""


@query(f"WITH {_TEMPLATES}, {_RESOLVED} SELECT * FROM found")
def prompt_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.resolve(_requests(spark, sf_dir), _templates(spark, sf_dir))


@query(f"WITH {_TEMPLATES}, {_RESOLVED} SELECT prompt_key, client_id, coalesce(nullif(text, ''), 'be brief') AS text, 'be brief' AS plain FROM found")
def prompt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts.resolve(_requests(spark, sf_dir), _templates(spark, sf_dir))
    return found.select("prompt_key", "client_id", prompts.or_fallback("text", "be brief").alias("text"), prompts.default_prompt("be brief").alias("plain"))


@query(f"WITH {_TEMPLATES} SELECT prompt_key, client_id, version, best.t AS prompt_text FROM act WHERE client_id IS NULL OR client_id = 2")
def prompt_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.visible(_templates(spark, sf_dir), 2).select("prompt_key", "client_id", "version", "prompt_text")


@query(f"WITH {_TEMPLATES} SELECT prompt_key, client_id, version, CAST(lag(version) OVER (PARTITION BY prompt_key, client_id ORDER BY version) AS INTEGER) AS previous_version FROM templates")
def prompt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.versions(_templates(spark, sf_dir)).select("prompt_key", "client_id", "version", "previous_version")


@query(f"WITH {_TEMPLATES} SELECT version, prompt_text FROM templates WHERE prompt_key = (SELECT min(p_type) FROM part) AND client_id IS NULL")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return prompts.history(_templates(spark, sf_dir), key).select("version", "prompt_text")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new text for every prompt key, for the global row and a client without versions (7)."""
    t = _templates(spark, sf_dir)
    keys = t.select("prompt_key").distinct().select("prompt_key", F.explode(F.array(F.lit(None).cast("int"), F.lit(7))).alias("client_id"))
    null = {f.name: F.lit(None).cast(f.dataType) for f in t.schema.fields}
    values = null | {"prompt_key": F.col("prompt_key"), "client_id": F.col("client_id"), "prompt_text": F.concat(F.lit("new "), "prompt_key"), "include_in_quality_analysis": F.lit(True), "version": F.lit(1)}
    return keys.select(*[values[f.name].alias(f.name) for f in t.schema.fields])


_CHANGED = """
changes AS (SELECT DISTINCT prompt_key, c AS client_id FROM templates, (SELECT unnest([NULL, 7]) AS c)),
after AS (
  SELECT prompt_key, client_id, prompt_text, is_active AND client_id IS NOT NULL AS is_active, version FROM templates
  UNION ALL SELECT c.prompt_key, c.client_id, 'new ' || c.prompt_key, true, CAST(coalesce((SELECT max(version) FROM templates t WHERE t.prompt_key = c.prompt_key AND t.client_id IS NOT DISTINCT FROM c.client_id), 0) + 1 AS INTEGER) FROM changes c)"""


@query(f"WITH {_TEMPLATES}, {_CHANGED} SELECT * FROM after")
def prompt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.upsert(_templates(spark, sf_dir), _changes(spark, sf_dir)).select("prompt_key", "client_id", "prompt_text", "is_active", "version")


@query(
    f"WITH {_TEMPLATES}, {_CHANGED} SELECT c.prompt_key, c.client_id, (SELECT max(version) FROM templates t WHERE is_active AND t.prompt_key = c.prompt_key AND t.client_id IS NULL) AS previous_version, "
    "(SELECT max(version) FROM after t WHERE is_active AND t.prompt_key = c.prompt_key AND t.client_id IS NULL) AS new_version FROM changes c WHERE c.client_id IS NULL AND EXISTS (SELECT 1 FROM templates t WHERE is_active AND t.prompt_key = c.prompt_key AND t.client_id IS NULL)"
)
def prompt_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _templates(spark, sf_dir)
    return prompts.superseded(before, prompts.upsert(before, _changes(spark, sf_dir)))


@query(f"WITH {_TEMPLATES} SELECT prompt_template_id, is_active AND NOT (prompt_key = (SELECT min(p_type) FROM part) AND client_id IS NOT DISTINCT FROM 1) AS is_active FROM templates")
def prompt_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return prompts.reset(_templates(spark, sf_dir), key, 1).select("prompt_template_id", "is_active")


@query(
    f"WITH {_TEMPLATES}, one AS (SELECT * FROM templates WHERE prompt_key = (SELECT min(p_type) FROM part) AND client_id IS NULL) "
    "SELECT prompt_key, client_id, version, prompt_text, is_active AND NOT (EXISTS (SELECT 1 FROM one WHERE version = 1) AND prompt_key = (SELECT min(p_type) FROM part) AND client_id IS NULL) AS is_active FROM templates "
    "UNION ALL SELECT prompt_key, client_id, CAST((SELECT max(version) FROM one) + 1 AS INTEGER), prompt_text, true FROM one WHERE version = 1"
)
def prompt_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    once = prompts.rollback(_templates(spark, sf_dir), key, None, 1)
    return prompts.rollback(once, key, None, 1_000_000).select("prompt_key", "client_id", "version", "prompt_text", "is_active")


@query("SELECT conv_id, turn, role AS prompt_key, text AS prompt_text, CAST(NULL AS VARCHAR) AS model_id FROM conversations")
def prompt_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("role").alias("promptKey"), F.col("text").alias("promptText"), F.lit(1).alias("other")))
    return c.select("conv_id", "turn", prompts.egress_record(body).alias("e")).select("conv_id", "turn", F.col("e.promptKey").alias("prompt_key"), F.col("e.promptText").alias("prompt_text"), F.col("e.modelId").alias("model_id"))


@query(
    f"WITH {_TEMPLATES}, {_RESOLVED} SELECT prompt_key, client_id, coalesce(nullif(text, ''), 'be brief') AS before, CASE WHEN prompt_key <> 'none such' AND (client_id IS NULL OR client_id = 1) THEN 'new ' || prompt_key "
    "ELSE coalesce(nullif(text, ''), CASE WHEN prompt_key <> 'none such' AND NOT EXISTS (SELECT 1 FROM act a WHERE a.prompt_key = found.prompt_key AND (a.client_id IS NULL OR a.client_id = found.client_id)) THEN 'new ' || prompt_key ELSE 'be brief' END) END AS after, "
    "CASE WHEN prompt_key <> 'none such' AND client_id IS NULL OR client_id = 1 AND prompt_key <> 'none such' THEN (SELECT max(version) FROM templates t WHERE is_active AND t.prompt_key = found.prompt_key AND t.client_id IS NOT DISTINCT FROM found.client_id) END AS superseded FROM found"
)
def prompt_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through the cache, before and after new versions of the global prompts and client 1's: what others fell back to stays until it expires.

    The hook hears of every version that was superseded.
    """
    told: list[DataFrame] = []

    class Hook:
        def superseded(self, events: DataFrame) -> None:
            told.append(events)

    repository = prompts.SnapshotRepository(spark, f"{shared_folder(spark)}/prompts-{uuid.uuid4().hex}")
    repository.save(_templates(spark, sf_dir))
    service = prompts.PromptService(repository, hook=Hook())
    pairs = [tuple(r) for r in _requests(spark, sf_dir).collect()]  # prompt keys by clients
    before = service.texts(pairs)
    changed = _changes(spark, sf_dir)
    service.upsert(changed.withColumn("client_id", F.when(F.col("client_id") == 7, F.lit(1))))
    after = service.texts(pairs)
    rows = spark.createDataFrame([(*p, before[p] or "be brief", after[p] or "be brief") for p in pairs], "prompt_key string, client_id int, before string, after string")
    events = told[0].select(F.col("prompt_key").alias("k"), F.col("client_id").alias("c"), F.col("previous_version").alias("superseded"))
    return rows.join(events, (F.col("prompt_key") == F.col("k")) & F.col("client_id").eqNullSafe(F.col("c")), "left").drop("k", "c")


def _fetch(key: str) -> tuple[int, str | None]:
    if key.startswith("STANDARD"):
        raise OSError("down")
    return {"E": (404, None), "L": (500, "not this"), "M": (200, None), "P": (200, f"remote {key}")}.get(key[0], (200, "other"))


@query("SELECT prompt_key, CASE WHEN prompt_key LIKE 'P%' THEN 'remote ' || prompt_key WHEN prompt_key LIKE 'S%' AND prompt_key NOT LIKE 'STANDARD%' THEN 'other' ELSE 'be brief' END AS text, CAST(CASE WHEN prompt_key LIKE 'L%' OR prompt_key LIKE 'STANDARD%' THEN 2 ELSE 1 END AS INTEGER) AS calls FROM (SELECT DISTINCT p_type AS prompt_key FROM part)")
def prompt_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys asked twice: found ones and 404s are remembered, failures aren't."""
    asked: list[str] = []

    def fetch(key: str) -> tuple[int, str | None]:
        asked.append(key)
        return _fetch(key)

    source = prompts.RemotePrompts(fetch)
    wanted = [(r[0], "be brief") for r in _table(spark, sf_dir, "part").select("p_type").distinct().collect()]  # prompt keys
    source.table(spark, wanted)
    texts = source.table(spark, wanted)
    calls = spark.createDataFrame([(k, asked.count(k)) for k, _ in wanted], "prompt_key string, calls int")
    return texts.join(calls, "prompt_key")


# agents


class _Length(agents.Agent):
    key, fallback_prompt, schema = "length", "count", T.LongType()

    def build_user(self, row: dict) -> str:
        return f"{row['doc_id']}:{row['text'] or ''}"

    def parse(self, raw: str) -> int:
        return int(raw)

    def on_failure(self) -> int:
        return -1


def _length_chat(turn: dict) -> str:
    doc, text = turn["user"].split(":", 1)
    if int(doc) % 7 == 0:
        raise RuntimeError("no answer")
    return str(len(text) + len(turn["system"]))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE length(coalesce(text, '')) + CASE WHEN source IS NOT NULL AND source < 'm' THEN 9 ELSE 5 END END AS result FROM documents")
def agent_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts; sources before "m" have a system prompt of their own."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    own = docs.where("source < 'm'").select(F.lit("length").alias("prompt_key"), F.col("source").alias("client_id"), F.lit("count all").alias("text")).distinct()
    return _Length().run(docs, _length_chat, own, client="source").select("doc_id", "result")


class _Label(agents.BatchAgent):
    schema = T.StringType()

    def build_user(self, items: list[dict]) -> str:
        return ",".join(str(i["doc_id"]) for i in items)

    def try_parse(self, raw: str, items: list[dict]) -> list[str] | None:
        parts = raw.split(",")
        return parts if len(parts) == len(items) else None

    def flagged(self, item: dict) -> str:
        return f"flagged {item['doc_id']}"


def _label_chat(turn: dict) -> str:
    docs = turn["user"].split(",")
    first = int(docs[0])
    if first % 5 == 1:
        raise RuntimeError("no answer")
    return "?" if first % 5 == 2 else ",".join(f"ok {d}" for d in docs)


@query(
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents), c AS (SELECT *, min(doc_id) OVER (PARTITION BY p // 12) AS lead FROM n)
SELECT CAST(p AS BIGINT) AS position, CASE WHEN lead % 5 IN (1, 2) AND (p // 12 >= 0) AND NOT (lead % 5 = 2 AND count(*) OVER (PARTITION BY p // 12) = 1) THEN 'flagged ' ELSE CASE WHEN lead % 5 = 2 THEN '?' ELSE 'ok ' END END
  || CASE WHEN lead % 5 = 2 AND count(*) OVER (PARTITION BY p // 12) = 1 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS result FROM c"""
)
def batch_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(_table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])
    return _Label().run(docs, _label_chat, "ordinal")
