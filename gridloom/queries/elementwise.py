"""Scalar words, element-wise operators, fills and reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions import vector as V
from gridloom.operators import coo
from gridloom.queries.base import E, IMG, cells, embeddings, image, over_cells, query, r6, table
from gridloom.sources import summary

KEYS = ("l_orderkey", "l_linenumber")


def _line(spark: SparkSession, d: str, **columns) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEYS, *[c.alias(n) for n, c in columns.items()])


def _sql(**columns: str) -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM lineitem"


def _columns() -> tuple[Column, Column, Column, Column]:
    """Quantity, price, discount and tax; made on use, as columns need a session."""
    return F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")


@query(
    "scalar_arith",
    _sql(
        added=r6("l_quantity + l_tax"), taken=r6("l_quantity - l_tax"), product=r6("l_extendedprice * l_discount"), quotient="round(l_extendedprice / l_quantity, 8)",
        negated="-l_quantity", absolute=r6("abs(l_discount - 0.05::DOUBLE)"), doubled=r6("l_extendedprice * 2"), halved=r6("l_extendedprice / 2"),
        more="l_quantity + 1", less="l_quantity - 1", largest=r6("greatest(l_tax, l_discount)"), smallest=r6("least(l_tax, l_discount)"),
    ),
)
def scalar_arith(spark: SparkSession, d: str) -> DataFrame:
    q, p, dsc, tax = _columns()
    return _line(
        spark, d, added=S.tidy(q + tax), taken=S.tidy(q - tax), product=S.tidy(p * dsc), quotient=S.tidy(p / q, 8), negated=-q, absolute=S.tidy(F.abs(dsc - 0.05)),
        doubled=S.tidy(p * 2), halved=S.tidy(p / 2), more=q + 1, less=q - 1, largest=S.tidy(F.greatest(tax, dsc)), smallest=S.tidy(F.least(tax, dsc)),
    )


_I, _J = "CAST(trunc(l_quantity) AS INTEGER)", "CAST(trunc(l_extendedprice) AS INTEGER)"


@query(
    "scalar_intbits",
    _sql(
        both=f"CAST({_I} & {_J} AS DOUBLE)", either=f"CAST({_I} | {_J} AS DOUBLE)", one=f"CAST(xor({_I}, {_J}) AS DOUBLE)", inverted=f"CAST(~{_I} AS DOUBLE)",
        right_=f"CAST({_J} >> 3 AS DOUBLE)", left_=f"CAST({_I} << 4 AS DOUBLE)", below=f"CASE WHEN {_I} < {_J} THEN -1 ELSE 0 END",
    ),
)
def scalar_intbits(spark: SparkSession, d: str) -> DataFrame:
    q, p, _, _ = _columns()
    return _line(
        spark, d, both=S.bit_and(q, p), either=S.bit_or(q, p), one=S.bit_xor(q, p), inverted=S.invert(q), right_=S.rshift(p, 3), left_=S.lshift(q, 4),
        below=S.flag(S.unsigned(q) < S.unsigned(p)),
    )


@query(
    "scalar_mod_family",
    _sql(
        whole=f"CAST({_J} % 7 AS DOUBLE)", real=r6("l_extendedprice % 7.5::DOUBLE"), rest=r6("l_extendedprice % l_quantity"), ratio="round(l_extendedprice / l_quantity, 8)",
        scaled=r6("l_extendedprice * l_quantity / 3"), rest_of_product=r6("(l_extendedprice * l_quantity) % 1000::DOUBLE"), floored="floor(l_extendedprice * l_quantity / 1000)",
    ),
)
def scalar_mod_family(spark: SparkSession, d: str) -> DataFrame:
    q, p, _, _ = _columns()
    rest, ratio = S.divmod_plain(p, q)
    product, floored = S.muldivmod(p, q, 1000.0)
    return _line(
        spark, d, whole=S.mod(p, 7.0), real=S.tidy(S.fmod(p, 7.5)), rest=S.tidy(rest), ratio=S.tidy(ratio, 8), scaled=S.tidy(S.muldiv(p, q, 3.0)),
        rest_of_product=S.tidy(product), floored=floored,
    )


@query("scalar_round_family", _sql(rounded="round(l_extendedprice / 7)", up="ceil(l_extendedprice / 7)", down="floor(l_extendedprice / 7)", cut="CAST(trunc(l_extendedprice / 7) AS INTEGER)", minus="-round(l_extendedprice / 7)"))
def scalar_round_family(spark: SparkSession, d: str) -> DataFrame:
    _, p, _, _ = _columns()
    x = p / 7
    return _line(spark, d, rounded=S.half_away(x), up=F.ceil(x).cast("double"), down=F.floor(x).cast("double"), cut=S.integer(x), minus=S.half_away(-x))


@query(
    "scalar_trig_log",
    _sql(
        e=r6("exp(-l_discount * 10)"), th=r6("tanh(l_discount * 10)"), sg=r6("1 / (1 + exp(-l_discount * 10))"), root=r6("sqrt(l_quantity)"), inverse=r6("1 / l_quantity"),
        clamped=r6("least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 20))"), nat=r6("ln(greatest(l_extendedprice, 1e-12))"), dec=r6("log10(greatest(l_tax, 1e-12))"),
        zeroed=r6("CASE WHEN l_tax > 1e-6 THEN ln(l_tax) ELSE 0 END"), si=r6("sin(l_quantity)"), co=r6("cos(l_quantity)"), power=r6("pow(l_quantity, 1.5)"), pi=r6("l_quantity * 3.1415927::DOUBLE"),
    ),
)
def scalar_trig_log(spark: SparkSession, d: str) -> DataFrame:
    q, p, dsc, tax = _columns()
    return _line(
        spark, d, e=S.tidy(F.exp(-dsc * 10)), th=S.tidy(F.tanh(dsc * 10)), sg=S.tidy(S.sigmoid(dsc * 10)), root=S.tidy(S.root(q)), inverse=S.tidy(1 / q), clamped=S.tidy(S.sat(q / 20)),
        nat=S.tidy(S.ln(p)), dec=S.tidy(S.log10(tax)), zeroed=S.tidy(S.ln_scalar(tax)), si=S.tidy(F.sin(q)), co=S.tidy(F.cos(q)), power=S.tidy(F.pow(q, F.lit(1.5))), pi=S.tidy(q * 3.1415927),
    )


@query(
    "scalar_compare_eps",
    _sql(
        eq="CASE WHEN abs(l_tax - l_discount) < 1e-6 THEN -1 ELSE 0 END", lt="CASE WHEN l_tax - l_discount < -1e-6 THEN -1 ELSE 0 END", gt="CASE WHEN l_tax - l_discount > 1e-6 THEN -1 ELSE 0 END",
        ne="CASE WHEN abs(l_tax - l_discount) < 1e-6 THEN 0 ELSE -1 END", ge="CASE WHEN l_tax - l_discount < -1e-6 THEN 0 ELSE -1 END", le="CASE WHEN l_tax - l_discount > 1e-6 THEN 0 ELSE -1 END",
        zero="CASE WHEN abs(l_tax) < 1e-6 THEN -1 ELSE 0 END",
    ),
)
def scalar_compare_eps(spark: SparkSession, d: str) -> DataFrame:
    _, _, dsc, tax = _columns()
    return _line(
        spark, d, eq=S.flag(S.equal(tax, dsc)), lt=S.flag(S.less(tax, dsc)), gt=S.flag(S.greater(tax, dsc)), ne=S.flag(~S.equal(tax, dsc)), ge=S.flag(~S.less(tax, dsc)),
        le=S.flag(~S.greater(tax, dsc)), zero=S.flag(S.equal(tax, 0.0)),
    )


@query("format_sprintf", "SELECT p_partkey, printf('%d|%.2f|%x|%s|%%', p_size, p_retailprice, p_size, p_brand) AS text FROM part")
def format_sprintf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.format_string("%d|%.2f|%x|%s|%%", "p_size", "p_retailprice", "p_size", "p_brand").alias("text"))


@query("ew_tensor_scalar", over_cells("((v * 3 + 0.25) - 0.125) / 2"))
def ew_tensor_scalar(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    for op, s in (("*", 3.0), ("+", 0.25), ("-", 0.125), ("/", 2.0)):
        x = V.tensor_scalar(x, op, s)
    return cells(embeddings(spark, d), x)


@query("ew_scalar_tensor", over_cells("1 - 2 / (4 + v)"))
def ew_scalar_tensor(spark: SparkSession, d: str) -> DataFrame:
    return cells(embeddings(spark, d), V.scalar_tensor(1.0, "-", V.scalar_tensor(2.0, "/", V.scalar_tensor(4.0, "+", F.col("x")))))


@query("ew_tensor_tensor", f"WITH {E} SELECT a.vec_id, a.k, {r6('a.v * b.v + a.v - b.v')} AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.k = b.k")
def ew_tensor_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one."""
    x = embeddings(spark, d).select("vec_id", "x")
    both = x.join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return cells(both, V.tensor_tensor(V.tensor_tensor(V.tensor_tensor(F.col("x"), "*", F.col("y")), "+", F.col("x")), "-", F.col("y")))


@query("ew_broadcast_n", f"WITH {IMG} SELECT a.n, a.h, a.w, {r6('a.v + b.v')} AS v FROM img a JOIN img b ON b.n = 0 AND a.h = b.h AND a.w = b.w")
def ew_broadcast_n(spark: SparkSession, d: str) -> DataFrame:
    """Sample 0 added to every sample."""
    t = image(spark, d)
    return coo.combine(t, t.where("n = 0"), "+", ["h", "w", "c"]).select("n", "h", "w", S.tidy(F.col("v")).alias("v"))


_WORDS = ("abs", "negate", "exp", "ln", "log", "tanh", "relu", "sigmoid", "sqrt", "1/x", "sat", "sin", "cos")
_NAMES = ("absolute", "negated", "e", "nat", "dec", "th", "rectified", "sg", "root", "inverse", "clamped", "si", "co")
_SQL_WORDS = (
    "abs(v)", "-v", "exp(v)", "ln(greatest(v, 1e-12))", "log10(greatest(v, 1e-12))", "tanh(v)", "greatest(v, 0)", "1 / (1 + exp(-v))", "sqrt(greatest(v, 0))", "1 / v",
    "least(1, greatest(0, v))", "sin(v)", "cos(v)",
)


@query("ew_unary_map", f"WITH {E} SELECT vec_id, k, " + ", ".join(f"round({e}, 4) + 0.0 AS {n}" for e, n in zip(_SQL_WORDS, _NAMES, strict=True)) + " FROM e")
def ew_unary_map(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    x = embeddings(spark, d).select("vec_id", F.posexplode("x").alias("k", "v"))
    return x.select("vec_id", "k", *[S.tidy(S.UNARY[w](v), 4).alias(n) for w, n in zip(_WORDS, _NAMES, strict=True)])


@query(
    "fill_gradfill_eye",
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0.0::DOUBLE AS zeros, 1.0::DOUBLE AS ones, 2.5::DOUBLE AS filled, (i * 6 + j) / 24.0::DOUBLE AS grad, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS eye FROM range(4) a(i), range(6) b(j)",
)
def fill_gradfill_eye(spark: SparkSession, d: str) -> DataFrame:
    out = coo.constant(spark, 4, 6, 0.0).withColumnRenamed("v", "zeros")
    for name, t in (("ones", coo.constant(spark, 4, 6, 1.0)), ("filled", coo.constant(spark, 4, 6, 2.5)), ("grad", coo.gradfill(spark, 4, 6)), ("eye", coo.eye(spark, 4, 6))):
        out = out.join(t.withColumnRenamed("v", name), ["i", "j"])
    return out


@query("fill_random", "SELECT 2 AS fills, 10000::BIGINT AS cells, true AS uniform_in_range, true AS uniform_centred, true AS normal_centred, true AS normal_unit FROM range(1)")
def fill_random(spark: SparkSession, d: str) -> DataFrame:
    u, z = coo.rand(spark, 100, 100, 7), coo.randn(spark, 100, 100, 8)
    a = u.agg(F.count("*").alias("cells"), ((F.min("v") > 0) & (F.max("v") <= 1)).alias("uniform_in_range"), (F.abs(F.avg("v") - 0.5) < 0.02).alias("uniform_centred"))
    b = z.agg((F.abs(F.avg("v")) < 0.05).alias("normal_centred"), (F.abs(F.stddev_pop("v") - 1) < 0.05).alias("normal_unit"))
    return a.crossJoin(b).select(F.lit(2).alias("fills"), "*")


@query(
    "red_sum_avg_std_norm",
    f"SELECT {r6('sum(l_quantity)')} AS total, {r6('avg(l_quantity)')} AS mean, {r6('stddev_pop(l_quantity)')} AS sd, round(sqrt(sum(l_quantity * l_quantity)), 4) + 0.0 AS norm FROM lineitem",
)
def red_sum_avg_std_norm(spark: SparkSession, d: str) -> DataFrame:
    q, _, _, _ = _columns()
    return table(spark, d, "lineitem").agg(S.tidy(F.sum(q)).alias("total"), S.tidy(F.avg(q)).alias("mean"), S.tidy(F.stddev_pop(q)).alias("sd"), S.tidy(F.sqrt(F.sum(q * q)), 4).alias("norm"))


@query("red_min_max", "SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem")
def red_min_max(spark: SparkSession, d: str) -> DataFrame:
    _, p, _, _ = _columns()
    return table(spark, d, "lineitem").agg(F.min(p).alias("least"), F.max(p).alias("most"))


@query("red_std_ref", "SELECT round(sqrt(sum((l_quantity - m) * (l_quantity - m))) / count(*), 9) + 0.0 AS sd FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def red_std_ref(spark: SparkSession, d: str) -> DataFrame:
    """The root is taken before the division by n: the population deviation over the root of n."""
    q, _, _, _ = _columns()
    return table(spark, d, "lineitem").agg(S.tidy(F.stddev_pop(q) / F.sqrt(F.count("*")), 9).alias("sd"))


@query("red_dot", f"WITH {E} SELECT a.vec_id, {r6('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON b.vec_id = 0 AND a.k = b.k GROUP BY a.vec_id")
def red_dot(spark: SparkSession, d: str) -> DataFrame:
    x = embeddings(spark, d)
    first = x.where("vec_id = 0").select(F.col("x").alias("y"))
    return x.crossJoin(F.broadcast(first)).select("vec_id", S.tidy(V.dot(F.col("x"), F.col("y"))).alias("v"))


@query("red_channel_stats", f"WITH {E} SELECT k, {r6('sum(v)')} AS total, {r6('avg(v)')} AS mean, {r6('avg(v * v)')} AS square, {r6('min(v)')} AS least, {r6('max(v)')} AS most FROM e GROUP BY k")
def red_channel_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    t = embeddings(spark, d).select(F.posexplode("x").alias("k", "v")).groupBy("k")
    return t.agg(*[S.tidy(f).alias(n) for n, f in (("total", F.sum(v)), ("mean", F.avg(v)), ("square", F.avg(v * v)), ("least", F.min(v)), ("most", F.max(v)))])


@query(
    "histo_30",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS top FROM lineitem),
b AS (SELECT CAST(least(29, greatest(0, floor((l_extendedprice - lo) / ((top - lo) / 30)))) + 1 AS INTEGER) AS bucket, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT CAST(g AS INTEGER) AS bucket, round(CASE WHEN g = 30 THEN top + 1e-10 ELSE lo + (top - lo) / 30 * g END, 6) AS hi, coalesce(n, 0) AS n FROM s, range(31) r(g) LEFT JOIN b ON b.bucket = g""",
)
def histo_30(spark: SparkSession, d: str) -> DataFrame:
    return summary.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30).select("bucket", F.round("hi", 6).alias("hi"), "n")


@query("nan_inf_count", "SELECT count(*) FILTER (l_quantity % 10 = 0) AS nans, count(*) FILTER (l_quantity % 10 = 1) AS infs, count(*) AS n FROM lineitem")
def nan_inf_count(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth quantity spoilt in either way, and found again."""
    q, _, _, _ = _columns()
    bad = F.when(q % 10 == 0, F.lit(float("nan"))).when(q % 10 == 1, F.lit(float("inf"))).otherwise(q)
    return table(spark, d, "lineitem").select(bad.alias("v")).agg(F.count_if(S.broken(F.col("v")) & F.isnan("v")).alias("nans"), F.count_if(S.broken(F.col("v")) & ~F.isnan("v")).alias("infs"), F.count("*").alias("n"))
