"""The registered queries of the rename engine over the driver's tables as virtual inventories, and their SQL.

``V1`` to ``V5`` turn documents, events, orders, parts and pages into inventories; every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions import dates, keys
from filewright.functions import names as N
from filewright.operators import collection, pairing, plan, report
from filewright.plans import commands
from filewright.plans.options import RenameOptions
from filewright.sources.inventory import from_table, probe, scan_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
IN_PLACE, ELSEWHERE = RenameOptions("/src"), RenameOptions("/src", "/out")
SKIPPING = RenameOptions("/src", "/out", copy=True, skip_duplicates=True)
DATE_WITHOUT_KEY = r"/^{y}-{m}-{d} {H}-{i}-{s}-\d+(\.jpg)$/"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents")
    return from_table(df, F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit("/Doc_"), "doc_id", F.lit(".TXT")), content=F.col("text"))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    base = F.concat(F.lit("/src/"), "event_type", F.lit("/IMG_"), "event_id")
    micro = F.date_format("ts", "SSSSSS")
    sub = F.when(F.col("event_id") % 2 == 0, F.left(micro, F.lit(3))).otherwise(micro)
    exif = F.struct(F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("date_time_original"), sub.alias("sub_sec_time_original"))
    images = from_table(df, F.concat(base, F.lit(".JPG")), exif=exif)
    videos = from_table(df.where("event_id % 5 = 0"), F.concat(base, F.lit(".MOV")), exif=F.lit(None).cast("struct<date_time_original:string,sub_sec_time_original:string>"))
    return images.unionByName(videos)


def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return from_table(df, F.concat(F.lit("/src/"), "o_orderstatus", F.lit("/"), F.date_format("o_orderdate", "yy-MM-dd HH-mm-ss"), F.lit("-"), "o_orderkey", F.lit(".jpg")))


def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = _table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")))
    return from_table(df, F.concat(F.lit("/src/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("-duplicate-"), F.format_string("%03d", "n"), F.lit(".jpeg")))


def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1))
    return from_table(df, F.concat(F.lit("/src/"), "page_id", "p"), content=F.col("html"))


V_SQL = {
    "v1": "SELECT '/src/' || source || '/' || lang || '/Doc_' || doc_id || '.TXT' AS path, text AS content FROM documents",
    "v2": """SELECT '/src/' || event_type || '/IMG_' || event_id || '.JPG' AS path, strftime(ts, '%Y:%m:%d %H:%M:%S') AS dto,
  CASE WHEN event_id % 2 = 0 THEN substr(strftime(ts, '%f'), 1, 3) ELSE strftime(ts, '%f') END AS sst FROM events
  UNION ALL SELECT '/src/' || event_type || '/IMG_' || event_id || '.MOV', NULL, NULL FROM events WHERE event_id % 5 = 0""",
    "v3": "SELECT '/src/' || o_orderstatus || '/' || strftime(o_orderdate, '%y-%m-%d %H-%M-%S') || '-' || o_orderkey || '.jpg' AS path FROM orders",
    "v4": """SELECT '/src/' || p_brand || '/' || replace(p_name, ' ', '_') || '-duplicate-' ||
  printf('%03d', row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey)) || '.jpeg' AS path FROM part""",
    "v5": r"""SELECT '/src/' || page_id || p AS path, html AS content FROM
  (SELECT page_id, html, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)""",
}


def parts_sql(inventory: str) -> str:
    """The inventory's SQL with dir, filename, stem and ext."""
    return rf"""SELECT *, CASE WHEN filename = '.' || ext OR NOT ends_with(filename, '.' || ext) THEN filename
    ELSE substr(filename, 1, length(filename) - length(ext) - 1) END AS stem
  FROM (SELECT *, regexp_extract(filename, '\.([^.]*)$', 1) AS ext
    FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS filename FROM ({inventory})))"""


def name_parts_sql(name: str, prefix: str) -> str:
    ext = rf"regexp_extract({name}, '\.([^.]*)$', 1)"
    return f"""CASE WHEN {name} = '.' || {ext} OR NOT ends_with({name}, '.' || {ext}) THEN {name}
    ELSE substr({name}, 1, length({name}) - length({ext}) - 1) END AS {prefix}_stem, {ext} AS {prefix}_ext"""


INHERIT = "regexp_replace(stem, '-duplicate-[0-9]{3}$', '') || '.' || ext"


def target_dir_sql(target: str) -> str:
    return f"rtrim('{target}/' || trim(replace(dir, '/src', ''), '/'), '/')"


def rows_sql(inventory: str, new_name: str, key: str, target: str = "/src", where: str = "true") -> str:
    """Rows with targets and keys, as ``with_targets`` gives them."""
    return f"""SELECT *, {key} AS group_key, 0 AS phase FROM (SELECT *, {target_dir_sql(target)} || '/' || new_name AS target_path,
    {name_parts_sql("new_name", "t")} FROM (SELECT *, {new_name} AS new_name FROM ({parts_sql(inventory)}) WHERE {where}) WHERE new_name IS NOT NULL)
  WHERE {key} IS NOT NULL"""


def plan_sql(rows: str, target: str = "/src", existing: str | None = None, own_ext: bool = False, skip: bool = False, copy: bool = False) -> str:
    """The plan's SQL, for groups without taken numbers."""
    order = "OVER (PARTITION BY group_key ORDER BY phase, path"
    ext = "ext" if own_ext else "g_ext"
    act = "copy" if copy else "move"
    return f"""WITH r AS ({rows}),
g AS (SELECT *, first_value(t_stem) {order}) AS g_stem, first_value(t_ext) {order}) AS g_ext, {target_dir_sql(target)} AS t_dir FROM r),
x AS (SELECT *, {ext} AS end_ext, t_dir || '/' || g_stem || '.' || {ext} AS target FROM g),
n AS (SELECT *, sum(CASE WHEN path = target THEN 1 ELSE 0 END) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS noops FROM x),
k AS (SELECT *, CAST(row_number() {order}) - 1 AS INTEGER) AS idx FROM n WHERE NOT (path = target AND noops = 1)),
e AS (SELECT k.*, {"d.p IS NOT NULL" if existing else "false"} AS there FROM k {f"LEFT JOIN (SELECT DISTINCT path AS p FROM ({existing})) d ON d.p = k.target" if existing else ""}),
c AS (SELECT *, CASE WHEN there OR idx > 0 THEN CAST(sum(CASE WHEN there OR idx > 0 THEN 1 ELSE 0 END) {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) END AS dup_no FROM e),
p AS (SELECT path AS source_path, CASE WHEN dup_no IS NULL THEN target ELSE t_dir || '/' || g_stem || '-duplicate-' || printf('%03d', dup_no) || '.' || end_ext END AS target_path, group_key, idx, dup_no FROM c),
f AS (SELECT *, contains(regexp_extract(target_path, '([^/]*)$', 1), '-duplicate-') AS is_duplicate FROM p)
SELECT *, CASE WHEN is_duplicate AND {str(skip).lower()} THEN 'skip' ELSE '{act}' END AS action FROM f"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def simple(name: str, view: Query, sql: str, columns: Callable[[], list], where: str | None = None) -> None:
    """A projection over an inventory with its name parts. sql: the columns' SQL over the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = N.decomposed(view(spark, sf_dir))
        return (df.where(where) if where else df).select("path", *columns())

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {sql} FROM ({parts_sql(V_SQL[view.__name__])})" + (f" WHERE {where}" if where else "")


C = F.col

# scalars
simple("p1_decompose", v5, "path, dir, filename, stem, ext", lambda: ["dir", "filename", "stem", "ext"])
simple("p2_strip_marker", v4, "path, regexp_replace(stem, '-duplicate-[0-9]{3}$', '') AS plain", lambda: [N.without_marker(C("stem")).alias("plain")])
simple("p3_inherit", v5, f"path, {INHERIT} AS new_name", lambda: [N.inherited(C("stem"), C("ext")).alias("new_name")])
simple("p4_lower", v1, f"path, lower({INHERIT}) AS new_name", lambda: [N.lower_case(C("stem"), C("ext")).alias("new_name")])
simple("p5_regex", v4, rf"path, regexp_replace({INHERIT}, '^(.+)(jpeg)$', '\1jpg', 'g') AS new_name", lambda: [N.replaced(C("stem"), C("ext"), commands.DEFAULT_PATTERN, commands.DEFAULT_REPLACEMENT).alias("new_name")])
simple("p5_posix_classes", v1, f"path, regexp_replace({INHERIT}, '[[:upper:]]+', 'X', 'g') AS new_name", lambda: [N.replaced(C("stem"), C("ext"), "/[[:upper:]]+/", "X").alias("new_name")])
DATE_GROUPS = r"^(\d{2})-(\d{2})-(\d{2}).(\d{2})-(\d{2})-(\d{2})(.+)$"
YEAR = "CASE WHEN CAST({y} AS INTEGER) >= 70 THEN CAST({y} AS INTEGER) + 1900 ELSE CAST({y} AS INTEGER) + 2000 END"


def date_sql(java: str, last: int) -> str:
    g = lambda k: f"regexp_extract({INHERIT}, '{java}', {k})"
    year = YEAR.format(y=g(1))
    return f"CASE WHEN regexp_matches({INHERIT}, '{java}') THEN printf('%04d', {year}) || '-' || {g(2)} || '-' || {g(3)} || '_' || {g(4)} || '-' || {g(5)} || '-' || {g(6)} || {g(last)} ELSE {INHERIT} END"


simple("p8_date_pattern", v3, f"path, {date_sql(DATE_GROUPS, 7)} AS new_name", lambda: [dates.date_renamed(C("stem"), C("ext"), commands.DEFAULT_DATE_PATTERN, commands.DEFAULT_DATE_REPLACEMENT).alias("new_name")])
simple("p9_two_digit_year", v3, f"path, {YEAR.format(y='substr(filename, 1, 2)')} AS year", lambda: [dates.four_digit_year(F.left(C("filename"), F.lit(2)).cast("int")).alias("year")])
MOMENT = "(strptime(dto, '%Y:%m:%d %H:%M:%S') + CASE WHEN length(sst) > 4 THEN to_microseconds(CAST(sst AS BIGINT)) ELSE to_milliseconds(CAST(sst AS BIGINT)) END)"
CAPTURED = f"CASE WHEN dto IS NOT NULL THEN strftime({MOMENT}, '%Y-%m-%d_%H-%M-%S-%g') || '.' || ext END"


def exif() -> tuple[Column, Column]:
    return C("exif.date_time_original"), C("exif.sub_sec_time_original")


simple("p10_capture_time", v2, f"path, {CAPTURED} AS new_name", lambda: [dates.capture_renamed(*exif(), C("ext")).alias("new_name")])
simple("p11_subsecond", v2, f"path, strftime({MOMENT}, '%f') AS micros", lambda: [F.date_format(dates.capture_time(*exif()), "SSSSSS").alias("micros")], where="path LIKE '%.JPG'")
simple("p12_target_path", v1, f"path, {target_dir_sql('/out')} || '/' || filename AS target_path", lambda: [N.target_path(C("dir"), C("filename"), "/src", "/out").alias("target_path")])
simple("p14_duplicate_name", v4, "path, stem || '-duplicate-' || printf('%03d', length(path) * 20) || '.' || ext AS name", lambda: [N.duplicate_name(C("stem"), F.length("path") * 20, C("ext")).alias("name")])
simple("p15_pair_stem", v5, "path, CASE WHEN ext = '' THEN path ELSE substr(path, 1, length(path) - length(ext) - 1) END AS pair", lambda: [N.pair_stem(C("path")).alias("pair")])
simple("p19_is_duplicate", v4, "path, contains(filename, '-duplicate-') AS is_duplicate", lambda: [N.is_duplicate(C("filename")).alias("is_duplicate")])
simple("g3_content_hash", v1, "path, sha256(content) AS group_key", lambda: [keys.content_key().alias("group_key")])


# filters and collection operations
def parted(view: Query) -> Query:
    return lambda spark, sf_dir: N.decomposed(view(spark, sf_dir)).select("path", "filename")


def parted_sql(view: str, where: str = "true") -> str:
    return f"SELECT path, filename FROM ({parts_sql(V_SQL[view])}) WHERE {where}"


query("f1_regex_filter", parted_sql("v5", "regexp_matches(filename, '^[0-9]+[.]html$')"))(lambda s, d: collection.filename_matches(parted(v5)(s, d), r"^[0-9]+[.]html$"))
query("f2_uppercase_filter", parted_sql("v1", "regexp_matches(filename, '[A-Z]')"))(lambda s, d: collection.with_upper_case(parted(v1)(s, d)))
query("f8_filter", parted_sql("v5", "length(filename) > 4"))(lambda s, d: collection.filtered(parted(v5)(s, d), F.length("filename") > 4))
query("o1_sort", parted_sql("v4"))(lambda s, d: parted(v4)(s, d).orderBy("filename", "path"))
query("o2_slice", parted_sql("v4") + " ORDER BY path OFFSET 100 LIMIT 50")(lambda s, d: collection.sliced(parted(v4)(s, d), ["path"], 100, 50))
query("o1_sort_ranks", f"SELECT path, filename, row_number() OVER (ORDER BY filename, path) - 1 AS rank FROM ({parted_sql('v4')})")(lambda s, d: collection.ranked(parted(v4)(s, d), ["filename", "path"]))
query("o2_slice_from_end", f"SELECT * FROM (SELECT path, filename, row_number() OVER (ORDER BY path) - 1 AS rank FROM ({parted_sql('v4')})) WHERE rank >= (SELECT count(*) - 120 FROM part) AND rank < (SELECT count(*) - 20 FROM part)")(lambda s, d: collection.sliced(parted(v4)(s, d), ["path"], -120, -20, rank="rank"))
query("o3_scan_ranks", f"SELECT path, filename, row_number() OVER (ORDER BY path) - 1 AS rank FROM ({parted_sql('v5')})")(lambda s, d: collection.ranked(parted(v5)(s, d), ["path"]))
query("o3_scan_order", parted_sql("v5"))(lambda s, d: scan_order(v5(s, d)).select("path", "filename"))
query("u2_append", parted_sql("v4") + " UNION ALL " + parted_sql("v5"))(lambda s, d: collection.appended(parted(v4)(s, d), parted(v5)(s, d)))
query("c1_lookup", parted_sql("v5", "filename IN ('1.html', '25', '100.html')"))(lambda s, d: collection.looked_up(parted(v5)(s, d), "filename", ["1.html", "25", "100.html"]))
query("f10_membership", parted_sql("v2", "path NOT LIKE '%.JPG'"))(lambda s, d: collection.without(parted(v2)(s, d), parted(v2)(s, d).where("path LIKE '%.JPG'")))
query("a1_count_files", f"SELECT count(*) AS n_files FROM ({V_SQL['v2']})")(lambda s, d: v2(s, d).agg(F.count("*").alias("n_files")))

# rows with targets
HASH_ROWS = rows_sql(V_SQL["v1"], INHERIT, "sha256(content)")
DATE_ROWS = rows_sql(V_SQL["v3"], date_sql(r"^(\d{2})-(\d{2})-(\d{2}) (\d{2})-(\d{2})-(\d{2})-\d+(\.jpg)$", 7), "target_path", "/out", r"regexp_matches(filename, '^(\d{2})-(\d{2})-(\d{2}) (\d{2})-(\d{2})-(\d{2})-\d+(\.jpg)$')")
EXIF_ROWS = rows_sql(V_SQL["v2"], CAPTURED, "t_stem || '.' || t_ext")


def hash_rows(options: RenameOptions = IN_PLACE) -> Query:
    return lambda s, d: commands.content_hash(options).rows(v1(s, d))


def date_rows(s: SparkSession, d: str) -> DataFrame:
    return commands.date(ELSEWHERE, DATE_WITHOUT_KEY).rows(v3(s, d))


def exif_primary(s: SparkSession, d: str) -> DataFrame:
    q = commands.exif_date(IN_PLACE)
    return plan.with_targets(v2(s, d), q.new_name, q.key, "/src", "/src")


def numbered_rows(s: SparkSession, d: str) -> DataFrame:
    return plan.with_ordinal(plan.without_first_noop(plan.group_targets(date_rows(s, d), "/src", "/out")))


SOME = "source_path, target_path, idx, dup_no, is_duplicate, action"
PLAN = ["source_path", "target_path", "idx", "dup_no", "is_duplicate", "action"]
query("f3_null_target", f"SELECT path, new_name FROM ({EXIF_ROWS})")(lambda s, d: exif_primary(s, d).select("path", "new_name"))
query("f4_null_key", "SELECT path, new_name FROM (" + rows_sql("SELECT path, CASE WHEN path LIKE '%/en/%' THEN content END AS content FROM (" + V_SQL["v1"] + ")", INHERIT, "sha256(content)") + ")")(
    lambda s, d: commands.content_hash(IN_PLACE).rows(v1(s, d).withColumn("content", F.when(C("path").like("%/en/%"), C("content")))).select("path", "new_name")
)
query("f7_no_metadata", f"SELECT path, new_name FROM (SELECT path, {CAPTURED} AS new_name FROM ({parts_sql(V_SQL['v2'])})) WHERE new_name IS NOT NULL")(
    lambda s, d: N.decomposed(v2(s, d)).select("path", dates.capture_renamed(*exif(), C("ext")).alias("new_name")).where("new_name is not null")
)
query("g1_target_path", f"SELECT group_key, count(*) AS n FROM ({DATE_ROWS}) GROUP BY group_key")(lambda s, d: date_rows(s, d).groupBy("group_key").agg(F.count("*").alias("n")))
query("g2_target_filename", f"SELECT group_key, count(*) AS n FROM ({EXIF_ROWS}) GROUP BY group_key")(lambda s, d: exif_primary(s, d).groupBy("group_key").agg(F.count("*").alias("n")))
query("g4_group_collect", f"SELECT group_key, string_agg(path, '|' ORDER BY path) AS files FROM ({HASH_ROWS}) GROUP BY group_key")(
    lambda s, d: hash_rows()(s, d).groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("files"))
)
query("g5_first_target", f"SELECT path, first_value(target_path) OVER (PARTITION BY group_key ORDER BY path) AS group_target FROM ({HASH_ROWS})")(
    lambda s, d: hash_rows()(s, d).select("path", F.first("target_path").over(plan.ordered()).alias("group_target"))
)
query("p13_group_target", f"SELECT path, {target_dir_sql('/src')} || '/' || first_value(t_stem) OVER (PARTITION BY group_key ORDER BY path) || '.' || first_value(t_ext) OVER (PARTITION BY group_key ORDER BY path) AS target FROM ({HASH_ROWS})")(
    lambda s, d: plan.group_targets(hash_rows()(s, d), "/src", "/src").select("path", "target")
)
query("w3_first_target", f"SELECT path, first_value(t_stem) OVER (PARTITION BY group_key ORDER BY path) AS g_stem FROM ({HASH_ROWS})")(lambda s, d: plan.group_targets(hash_rows()(s, d), "/src", "/src").select("path", "g_stem"))
HASH_PLAN = plan_sql(HASH_ROWS, existing=V_SQL["v1"])
query("f5_first_noop", f"SELECT source_path FROM ({HASH_PLAN})")(lambda s, d: plan.without_first_noop(plan.group_targets(hash_rows()(s, d), "/src", "/src")).select(C("path").alias("source_path")))
DATE_PLAN = plan_sql(DATE_ROWS, "/out")
query("w1_ordinal", f"SELECT source_path, idx FROM ({DATE_PLAN})")(lambda s, d: numbered_rows(s, d).select(C("path").alias("source_path"), "idx"))
query("c4_reindex", f"SELECT source_path, idx FROM ({HASH_PLAN})")(lambda s, d: plan.with_ordinal(plan.without_first_noop(plan.group_targets(hash_rows()(s, d), "/src", "/src"))).select(C("path").alias("source_path"), "idx"))
query("w2_duplicate_counter", f"SELECT source_path, dup_no FROM ({DATE_PLAN})")(lambda s, d: plan.numbered(numbered_rows(s, d), None).select(C("path").alias("source_path"), "dup_no"))
query("j2_exists", f"SELECT path, path LIKE '%.JPG' AS \"exists\" FROM ({V_SQL['v2']})")(lambda s, d: probe(v2(s, d).select("path"), v2(s, d).where("path LIKE '%.JPG'")).select("path", "exists"))

# numbers that are taken: every third number of each part's name is on disk, and so is the plain target
FREE_ROWS = f"""SELECT path, t_dir, base, row_number() OVER (PARTITION BY t_dir, base ORDER BY path) AS k FROM (SELECT path, regexp_replace(dir, '^/src', '/out') AS t_dir,
  regexp_replace(stem, '-duplicate-[0-9]{{3}}$', '') AS base FROM ({parts_sql(V_SQL["v4"])}))"""
# the numbers 1, 4, 7, ... are taken, so the k-th free one is k + (k + 1) // 2
W4_SQL = f"SELECT path AS source_path, t_dir || '/' || base || '-duplicate-' || printf('%03d', k + (k + 1) // 2) || '.jpeg' AS target_path FROM ({FREE_ROWS})"


@query("w4_free_number", W4_SQL)
def w4_free_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = v4(spark, sf_dir)
    rows = plan.with_targets(parts, N.inherited(C("stem"), C("ext")), keys.target_path_key(), "/src", "/out")
    sizes = rows.groupBy("target_path").agg(F.count("*").alias("n"))
    taken = sizes.select("target_path", F.explode(F.sequence(F.lit(1), (2 * F.col("n") + 2).cast("int"), F.lit(3))).alias("k"))
    numbers = taken.select(F.concat(F.regexp_replace("target_path", r"\.jpeg$", ""), F.lit(N.MARKER), F.format_string("%03d", "k"), F.lit(".jpeg")).alias("path"))
    existing = sizes.select(F.col("target_path").alias("path")).unionByName(numbers)
    return plan.rename_plan(rows, "/src", "/out", existing).select("source_path", "target_path")


# companions
COMPANION_ROWS = f"""SELECT v.path, v.dir, v.ext, p.g_stem AS t_stem, v.ext AS t_ext, p.g_stem || '.' || v.ext AS group_key, 1 AS phase
FROM ({parts_sql(V_SQL["v2"])}) v JOIN (SELECT path, first_value(t_stem) OVER (PARTITION BY group_key ORDER BY path) AS g_stem FROM ({EXIF_ROWS})) p
  ON substr(v.path, 1, length(v.path) - 4) = substr(p.path, 1, length(p.path) - 4) WHERE v.path LIKE '%.MOV'"""
MERGED_ROWS = f"SELECT path, dir, ext, t_stem, t_ext, group_key, phase FROM ({EXIF_ROWS}) UNION ALL {COMPANION_ROWS}"


def merged(s: SparkSession, d: str) -> DataFrame:
    return commands.exif_date(IN_PLACE).rows(v2(s, d))


query("j1_pairing", f"SELECT path, group_key FROM ({COMPANION_ROWS})")(lambda s, d: merged(s, d).where("phase = 1").select("path", "group_key"))
query("u1_merge", f"SELECT path, group_key, phase FROM ({MERGED_ROWS})")(lambda s, d: merged(s, d).select("path", "group_key", "phase"))
query("j3_upsert", f"SELECT group_key, count(*) AS n FROM ({MERGED_ROWS}) GROUP BY group_key")(lambda s, d: merged(s, d).groupBy("group_key").agg(F.count("*").alias("n")))
query("p16_companion_target", f"SELECT path, dir || '/' || t_stem || '.' || ext AS target FROM ({COMPANION_ROWS})")(lambda s, d: merged(s, d).where("phase = 1").select("path", pairing.companion_target().alias("target")))
query("p17_companion_key", f"SELECT path, t_stem || '.' || ext AS group_key FROM ({COMPANION_ROWS})")(lambda s, d: merged(s, d).where("phase = 1").select("path", pairing.companion_key().alias("group_key")))

# whole commands
LOWER_ROWS = rows_sql(V_SQL["v1"], f"lower({INHERIT})", "target_path")
PATTERN_ROWS = rows_sql(V_SQL["v4"], rf"regexp_replace({INHERIT}, '^(.+)(jpeg)$', '\1jpg', 'g')", "target_path", "/out", "regexp_matches(filename, '^(.+)(jpeg)$')")
HASH_OUT = plan_sql(rows_sql(V_SQL["v1"], INHERIT, "sha256(content)", "/out"), "/out")
HASH_SKIP = plan_sql(rows_sql(V_SQL["v1"], INHERIT, "sha256(content)", "/out"), "/out", skip=True, copy=True)


def command(name: str, sql: str, build: Callable[[], commands.RenameQuery], view: Query) -> None:
    query(name, f"SELECT {SOME} FROM ({sql})")(lambda s, d: build().plan(view(s, d)).select(*PLAN))


command("cmd_lower", plan_sql(LOWER_ROWS, existing=V_SQL["v1"]), lambda: commands.lower(IN_PLACE), v1)
command("cmd_pattern", plan_sql(PATTERN_ROWS, "/out"), lambda: commands.pattern(ELSEWHERE), v4)
command("cmd_date_pattern", DATE_PLAN, lambda: commands.date(ELSEWHERE, DATE_WITHOUT_KEY), v3)
command("cmd_hash", HASH_PLAN, lambda: commands.content_hash(IN_PLACE), v1)
#: Every seventh document's target is on disk already, without numbers.
OUT_V1 = "SELECT replace(path, '/src/', '/out/') AS path FROM (" + V_SQL["v1"] + ") WHERE CAST(regexp_extract(path, '([0-9]+)[.]TXT$', 1) AS BIGINT) % 7 = 0"
query("cmd_hash_existing", f"SELECT {SOME} FROM ({plan_sql(rows_sql(V_SQL['v1'], INHERIT, 'sha256(content)', '/out'), '/out', existing=OUT_V1)})")(
    lambda s, d: commands.content_hash(ELSEWHERE).plan(v1(s, d), v1(s, d).where("regexp_extract(path, '([0-9]+)[.]TXT$', 1) % 7 = 0").select(F.replace("path", F.lit("/src/"), F.lit("/out/")).alias("path"))).select(*PLAN)
)
command("cmd_hash_target", HASH_OUT, lambda: commands.content_hash(ELSEWHERE), v1)
command("f6_skip_duplicates", HASH_SKIP, lambda: commands.content_hash(SKIPPING), v1)
command("cmd_exifdate", plan_sql(MERGED_ROWS, existing=V_SQL["v2"], own_ext=True), lambda: commands.exif_date(IN_PLACE), v2)


def summarised(s: SparkSession, d: str) -> DataFrame:
    return report.summary(commands.content_hash(SKIPPING).plan(v1(s, d)))


SUMMARY = {"a2_count_groups": ("n_groups", "count(DISTINCT group_key)"), "a3_max_path_bytes": ("max_source_bytes", "CAST(max(strlen(source_path)) AS INTEGER)"), "a4_count_duplicates": ("n_duplicates", "count(*) FILTER (WHERE is_duplicate)"), "a5_count_renamed": ("n_files", "count(*) FILTER (WHERE action <> 'skip')")}
for _name, (_column, _sql) in SUMMARY.items():
    query(_name, f"SELECT {_sql} AS {_column} FROM ({HASH_SKIP})")(lambda s, d, c=_column: summarised(s, d).select(c))
query("k6_report_lines", f"SELECT source_path, rpad(source_path, CAST((SELECT max(strlen(source_path)) FROM ({HASH_OUT})) AS INTEGER), ' ') || ' → ' || target_path AS line FROM ({HASH_OUT})")(
    lambda s, d: report.lines(commands.content_hash(ELSEWHERE).plan(v1(s, d)))
)
