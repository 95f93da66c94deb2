"""Queries on the text functions and the grammar: one row of a table is one written form, and SQL says what it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import grammar, normalize, tolerance
from gaugeworks.functions.tolerance import Constraints
from gaugeworks.operators import cluster, filters, metering, pipeline, results, rules
from gaugeworks.operators.filters import TITLE_WORDS
from gaugeworks.plans.inputs import KEYS, spread, table
from gaugeworks.plans.registry import query

#: Of each line item: a whole number n, two digits dd, minutes mm, a digit t from 1 to 9, and its form k of so many.
_PARTS = """v as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(20 + l_partkey % 70 as varchar) as n, lpad(cast(l_suppkey % 100 as varchar), 2, '0') as dd,
         lpad(cast(l_suppkey % 60 as varchar), 2, '0') as mm, cast(1 + l_linenumber % 9 as varchar) as t, (l_orderkey + l_linenumber + l_partkey) % {} as k
  from lineitem)"""


def _written(spark: SparkSession, sf_dir: str, forms: list[list[str]]) -> DataFrame:
    """The keys of ``lineitem`` and ``raw_text``, in the row's form; of a form's parts n, dd, mm and t stand for the row's numbers."""
    c = {name: F.col(name) for name in KEYS}
    line = spread(table(spark, sf_dir, "lineitem").select(*KEYS))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    parts = {"n": (20 + c["l_partkey"] % 70).cast("string"), "dd": two(c["l_suppkey"] % 100), "mm": two(c["l_suppkey"] % 60), "t": (1 + c["l_linenumber"] % 9).cast("string")}
    k = (c["l_orderkey"] + c["l_linenumber"] + c["l_partkey"]) % len(forms)
    text: Column = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.concat(*[parts.get(p, F.lit(p)) for p in form])).otherwise(text)
    return line.withColumn("raw_text", text)


def _sql(wanted: dict[str, list[str]], more: str = "") -> str:
    """A row per line item; of each column the expression that belongs to the row's form."""
    count = len(next(iter(wanted.values())))
    columns = ["case k " + " ".join(f"when {i} then {w}" for i, w in enumerate(ws)) + f" end as {name}" for name, ws in wanted.items()]
    return f"with {_PARTS.format(count)} select {', '.join(KEYS + columns)}{more} from v"


# (written, in normal spelling)
_SYMBOLS = [
    (["%%c", "n"], "'Ø' || n"),
    (["PHI ", "n"], "'Ø ' || n"),
    (["dia ", "n"], "'Ø ' || n"),
    (["⌀", "n"], "'Ø' || n"),
    (["n", "。"], "n || '°'"),
    (["n", " deg"], "n || ' °'"),
    (["n", "′"], "n || chr(39)"),
    (["n", "″"], "n || chr(34)"),
    (["n", "''"], "n || chr(34)"),
    (["n", "+-0.", "t"], "n || '±0.' || t"),
    (["n", " + / 0.", "t"], "n || ' ±0.' || t"),
    (["n", " = ", "t"], "n || ' -' || t"),
    (["n", ",", "dd"], "n || '.' || dd"),
    (["n", "—0.", "t"], "n || '-0.' || t"),
    (["O°"], "'0°'"),
    (["n", "~|$", "t"], "n || t"),
]


@query(_sql({"clean": [w for _, w in _SYMBOLS]}))
def symbol_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, [f for f, _ in _SYMBOLS]).select(*KEYS, normalize.whitelist(normalize.normalize_symbols(F.col("raw_text"))).alias("clean"))


# (damaged, repaired)
_DAMAGED = [
    (["n", ".", "dd", " -0.0-", "t"], "n || '.' || dd || ' 0 -0.0' || t"),
    (["n", ".", "dd", " 0 -", "t"], "n || '.' || dd || ' 0 -0.0' || t"),
    (["n", ".", "dd", " +0.00", "t", " 1000+"], "n || '.' || dd || ' +0.00' || t || ' +0.001'"),
    (["n", ".", "dd", " +0.0", "t", " 001-"], "n || '.' || dd || ' +0.0' || t || ' -0.01'"),
    (["n", " ", "dd", " ±0.0", "t"], "n || '.' || dd || ' ±0.0' || t"),
    (["n", ":", "dd", " ±0.0", "t"], "n || '.' || dd || ' ±0.0' || t"),
    (["n", "-0", "t", " ±0.01"], "n || '.0' || t || ' ±0.01'"),
    (["O.", "t", " ±O.0", "t"], "'0.' || t || ' ±0.0' || t"),
    (["n", " . ", "dd"], "n || '.' || dd"),
    (["t", " 0 ", "t", " ±0.1"], "t || '0' || t || ' ±0.1'"),
    (["n", ".0 ", "t", " ±0.01"], "n || '.0' || t || ' ±0.01'"),
    (["--", "n", ".", "dd", "--"], "n || '.' || dd"),
    (["n", " -8.0", "t"], "n || ' -0.0' || t"),
    (["t", " 1 4", "t", " 0 -0.01"], "t || '1.4' || t || ' 0 -0.01'"),
    (["n", "~", "dd"], "n || '.' || dd"),
]


@query(_sql({"repaired": [w for _, w in _DAMAGED]}))
def damaged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, [f for f, _ in _DAMAGED]).select(*KEYS, normalize.repair_numbers(F.col("raw_text")).alias("repaired"))


_LINES = [
    (["-- ", "n", ",", "dd", " /\n\n!!\nO.", "t", "--"], "n || '.' || dd || chr(10) || '0.' || t"),
    (["t", " 1 4", "t"], "t || '1.4' || t"),
    (["___\n_ ", "n", " . ", "dd"], "n || '.' || dd"),
    (["φ", "n", "  x\n-0.", "dd"], "'Ø' || n || chr(10) || '-0.' || dd"),
]


@query(_sql({"clean": [w for _, w in _LINES]}))
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, [f for f, _ in _LINES]).select(*KEYS, normalize.clean_ocr(F.col("raw_text")).alias("clean"))


# (written, callout, type)
_CALLOUTS = [
    (["n", " TYP"], "n || ' ±0.2 TYP'", "global"),
    (["M", "n", "x1.25"], "'M ' || n || 'x1.25 ±0.05'", "global"),
    (["t", "-G", "n", "-6H"], "t || 'x G ' || n || '-6H ±0.2'", "global"),
    (["DP", "n"], "'DP ' || n || ' ±0.2'", "global"),
    (["n", " deep"], "n || ' ±0.2 DEEP'", "global"),
    (["C0.", "t", "x45°"], "'0.' || t || 'x45° ±0'", "angle"),
    (["(", "n", ")"], "'(' || n || ') ±0.2 REF'", "global"),
    (["[", "n", ".5]"], "'[' || n || '.5] ±0.05 INSPECT'", "global"),
    (["n", ".5 +0.1", "t", " +0.0", "t"], "n || '.5 +0.1' || t || '/+0.0' || t", "local"),
    (["n", ".5 -0.0", "t", " +0.1", "t"], "n || '.5 +0.1' || t || '/-0.0' || t", "local"),
    (["n", ".5 -0.0", "t", " / 0"], "n || '.5 0/-0.0' || t", "local"),
    (["+0.0", "t", " 0 ", "n"], "n || ' +0.0' || t || '/0'", "local"),
    (["0 -0.0", "t", " ", "n", ".5"], "n || '.5 0/-0.0' || t", "local"),
    (["n", ".5 -0.0", "t"], "n || '.5 0/-0.0' || t", "local"),
    (["hello"], "'hello'", "unknown"),
    (["n", "° ", "mm", " ", "mm"], "n || '°' || mm || chr(39) || mm || chr(34)", "angle"),
    (["n", "°", "mm", "' ± ", "t", "'"], "n || '°' || mm || chr(39) || ' ±' || t || chr(39)", "angle_tol"),
    (["n", "°", "mm", "' +1", "t", "' -1'"], "n || '°' || mm || chr(39) || ' +1' || t || chr(39) || '/-1' || chr(39)", "angle_tol"),
    (["n", "°6123°"], "n || '°'", "angle"),
    (["+0.0", "t", "\n", "n", ".5\n-0.1"], "n || '.5 +0.0' || t || '/-0.1'", "local_stacked"),
    (["SR", "n", ".5 MAX"], "'SR ' || n || '.5 ±0.1 MAX'", "global"),
    (["n", ".", "dd", " -0.0-", "t"], "n || '.' || dd || ' 0/-0.0' || t", "local"),
    (["n", ",5 ±0,", "t"], "n || '.5 ±0.' || t", "local"),
    (["%%c", "n", ".5 +0.1 -0.2"], "'Ø ' || n || '.5 +0.1/-0.2'", "local"),
    (["TAP M", "n", " HERE"], "'M M' || n || ' ±0.2'", "global"),
]


@query(_sql({"full_callout": [w for _, w, _ in _CALLOUTS], "tol_type": [f"'{t}'" for _, _, t in _CALLOUTS]}, ", k <> 14 as success"))
def callout_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.parse(_written(spark, sf_dir, [f for f, _, _ in _CALLOUTS])).select(*KEYS, "dim.full_callout", "dim.tol_type", "dim.success")


@query("""select p_partkey, case when p_partkey % 3 = 0 then null else 0.1 end::double as other,
  case when p_partkey % 3 = 0 then null when p_partkey % 40 + 1 <= 6 then 0.1 when p_partkey % 40 + 1 <= 30 then 0.2 else 0.3 end::double as unknown_grade from part""")
def general_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown mode, and an unknown grade by the band join; some sizes are null."""
    key = F.col("p_partkey")
    size = table(spark, sf_dir, "part").select("p_partkey", F.when(key % 3 != 0, (key % 40 + 1).cast("double")).alias("nominal"))
    out = tolerance.band_join(size, "nominal", "x", spark).withColumnRenamed("tol", "unknown_grade")
    other = tolerance.general_tolerance(F.col("nominal"), F.col("nominal").cast("string"), Constraints("something"))
    return out.select("p_partkey", F.when(F.col("nominal").isNotNull(), other).alias("other"), "unknown_grade")


@query("""select p_partkey, replace(replace(p_brand, 'B', '8'), '#', '-') as replaced, cast(p_size as varchar) || ' 0 -0.' || cast(1 + p_partkey % 9 as varchar) as joined, '+' || cast(p_size as varchar) as plus,
  case when length(p_name) > 12 then left(p_name, 6) || '••••••••' || right(p_name, 4) else '••••••••••••' end as masked from part""")
def text_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, t = F.col("p_size").cast("string"), (1 + F.col("p_partkey") % 9).cast("string")
    out = {
        "replaced": normalize.replace_characters(F.col("p_brand"), {"B": "8", "#": "-"}),
        "joined": normalize.join_cad_tokens(F.concat(size, F.lit("-0 0."), t)),
        "plus": normalize.join_cad_tokens(F.concat(F.lit("+  "), size)),
        "masked": normalize.masked_key(F.col("p_name")),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in out.items()])


_TITLED = " or ".join(f"contains(upper(p_name || ' ' || p_type), '{w}')" for w in TITLE_WORDS)


@query(f"""select p_partkey, p_partkey % 4 > 0 as ink, p_partkey % 4 <> 1 as signed, ({_TITLED}) and p_partkey % 2 = 0 as title,
  p_partkey % 3 = 0 as formula, p_partkey % 3 = 0 and p_partkey % 2 = 0 as formula_vector from part""")
def ink_and_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    bare = F.when(k % 4 == 0, "-").when(k % 4 == 1, "a").otherwise("7")
    signed = F.when(k % 4 == 1, "!").otherwise(bare)
    named = F.concat_ws(" ", "p_name", "p_type", F.when(k % 2 == 1, "1.5"))
    sums = F.concat(F.lit("A"), F.when(k % 3 == 0, "=").otherwise(""), F.when(k % 2 == 0, "+").otherwise("±"))
    out = {"ink": filters.has_ink(bare), "signed": filters.has_ink(signed, True), "title": filters.has_title_word(named, False), "formula": filters.is_formula(sums, False), "formula_vector": filters.is_formula(sums)}
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(c) for c, v in out.items()])


@query("""select p_partkey, case p_partkey % 5 when 0 then p_size + 0.5 when 1 then p_size + 0.0 when 4 then 0.36 end::double as vector,
  case p_partkey % 5 when 0 then p_size + 0.5 when 1 then p_size + 0.0 end::double as scanned from part""")
def leading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(size, F.lit(".5 TYP"))).when(k == 1, F.concat(F.lit(" +"), size)).when(k == 2, F.concat(F.lit("±"), size)).when(k == 3, "TYP 5").otherwise("-0.36")
    return table(spark, sf_dir, "part").select("p_partkey", cluster.leading_nominal(text, 0.35).alias("vector"), cluster.leading_nominal(text, 0.4).alias("scanned"))


@query("""select p_partkey, cast(10 + p_size as varchar) || case p_partkey % 4 when 0 then ' ±0.1' when 1 then ' +0.02/-0.03' else ' ±0.2' end as full_callout,
  case when p_partkey % 4 = 1 then 'reread' else 'grammar' end as source from part""")
def stacked_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, (10 + F.col("p_size")).cast("string")
    part = table(spark, sf_dir, "part")
    read = grammar.parse(part.select("p_partkey", F.when(k == 0, F.concat(size, F.lit(" ±0.1"))).otherwise(size).alias("raw_text"))).select("p_partkey", "dim", F.lit("grammar").alias("source"))
    seen = F.when(k < 3, F.array(F.lit("0.02"), F.lit("1")))  # the fourth crop was not read again
    texts = part.select("p_partkey", seen.alias("upper_texts"), F.when(k == 2, F.array(F.lit("x"))).when(k < 2, F.array(F.lit("- O.03"))).alias("lower_texts")).where("upper_texts is not null")
    return pipeline.reread_stacked(read, texts, ["p_partkey"]).select("p_partkey", "dim.full_callout", "source")


@query("select p_partkey, (p_size % 4 * 90 + 90) % 360 as crop_rotation from part where p_size <> 7")
def edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows a quarter turn further, but those that a user has deleted."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") % 4 * 90).alias("crop_rotation"))
    out = results.rotate(results.delete_rows(part, part.where("p_size = 7"), ["p_partkey"]))
    return out.select("p_partkey", F.col("crop_rotation").cast("int").alias("crop_rotation"))


@query("select p_partkey, p_size, row_number() over (order by p_partkey desc) as place from part qualify place <= 100")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of the result table as it is shown, the newest on top."""
    shown = results.by_id(table(spark, sf_dir, "part").select("p_partkey", "p_size"), id_col="p_partkey").limit(100)
    return results.number(shown, [F.desc("p_partkey")], name="place").select("p_partkey", "p_size", F.col("place").cast("long").alias("place"))


@query("select * from (values (1, 'own', false), (2, 'rule_dms_angle', true)) r(place, id, user_defined) where place = 1 or exists (select 1 from part where p_partkey % 3 = 0)")
def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns after learning texts of which some have a degree sign: the angle rule is added, once."""
    k = F.col("p_partkey")
    texts = table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.when(k % 3 == 0, "°").otherwise("")).alias("raw_text"))
    known = [{"id": "own", "pattern": "^x$", "type": "angle", "user_defined": False}]
    known = rules.learn_patterns(rules.learn_patterns(known, texts), texts)
    return spark.createDataFrame([(i + 1, r["id"], r["user_defined"]) for i, r in enumerate(known)], "place int, id string, user_defined boolean")


@query("select * from (values (1, 'b'), (2, 'a'), (3, 'c')) m(place, model)")
def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which models are tried."""
    return spark.createDataFrame(list(enumerate(metering.try_order("b", ["a", "b", "c", "a"]), 1)), "place int, model string")
