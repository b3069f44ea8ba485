"""Column profile of every load and what departs from the contract or from the source's other loads.

Values are generalised to character-class masks: texts to the classes of their characters, numbers to sign, leading digit and
place of the point, which keeps their order. One pass counts the masks of each load and group; null rates, value ranges,
dominant masks and violations under rare ones are read off these cells. So is how far a load's distribution of number masks
has moved from the other loads': the cells bound the others' median and the values far from it. Only where these bounds leave
a load undecided are the values themselves ranked, and distinct counts need them too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.functions.masks import mask, number_mask
from pitloom.operators.ranks import MOST_BUCKETS, MOST_CUTS, bucket_edges, null_safe
from pitloom.session import cut, together


@dataclass(frozen=True)
class ColumnContract:
    """What a column must hold: numbers, or texts of a ``format`` (a pattern for the whole text), from ``least`` on (above it if ``strict``)."""

    name: str
    least: float | None = None
    strict: bool = False
    format: str | None = None


@dataclass(frozen=True)
class Departures:
    """Limits: null share above the others, factor and share of far values, quotient of distinctness, share of a rare mask."""

    null_rate: float = 0.105
    far_factor: float = 5.0
    far_share: float = 0.5
    distinct: float = 1 / 3
    rare_mask: float = 0.005
    #: A group of more values than this is split at its approximate quantiles before it is sorted.
    hot_rows: int = 2_000_000


def _mask_of(column: Column, numeric: bool) -> Column:
    """``mask`` of the column's text. The text of a number has few kinds of characters, so one pattern does for it."""
    text = column.cast("string")
    if not numeric:
        return mask(text)
    digits = F.translate(F.regexp_replace(text, "[0-9]+", "9"), "E", "a")
    return F.when(digits.isin("NaN", "Infinity"), "a").when(digits == "-Infinity", "-a").otherwise(digits)


def _long(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None, mask_of=None) -> DataFrame:
    """One row per value: source, load, by, column (position of the contract), number, mask (by ``mask_of``, if given)."""
    cells = []
    for i, c in enumerate(contracts):
        value = df[c.name]
        number = value.cast("double") if c.format is None else F.when(value.rlike(f"^(?:{c.format})\\z"), F.expr(f"try_cast(`{c.name}` AS double)"))
        fields = [F.lit(i).alias("column"), F.when(~F.isnan(number), number).alias("number")]
        cells.append(F.struct(*fields, *([mask_of(value, c.format is None).alias("mask")] if mask_of else [])))
    keys = [df[source].alias("source"), df[load].alias("load"), (df[by] if by else F.lit("")).cast("string").alias("by")]
    return df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select("source", "load", "by", "cell.*")


def cells(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None = None) -> DataFrame:
    """Counts of each mask in each load, group and column: (source, load, by, column, mask, size, n, least, most).

    ``mask`` is that of a text, null for a null value, and one sign for all numbers of a numeric column; ``size`` is the mask
    of the number, null for what is none; ``least`` and ``most`` are the smallest and greatest number under it.
    """
    kinds = lambda value, numeric: F.when(value.isNotNull(), "9") if numeric else mask(value.cast("string"))
    return (
        _long(df, contracts, source, load, by, kinds)
        .groupBy("source", "load", "by", "column", "mask", number_mask(F.col("number")).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least"), F.max("number").alias("most"))
    )


def mask_cells(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None = None) -> DataFrame:
    """Counts of each mask (null: null values) in each load and column, with the range of the readable values under it."""
    return (
        _long(df, contracts, source, load, by, _mask_of)
        .groupBy("source", "load", "column", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("n_values"), F.min("number").alias("least"), F.max("number").alias("most"))
    )


def mask_profile(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, limits: Departures = Departures()) -> DataFrame:
    """Per load, column and mask: count, share among the load's texts, share in the source's other loads, and whether it is rare.

    A mask is dominant in a column if it is on at least ``rare_mask`` of the source's texts, else rare. Nulls have no mask and
    are left out; a source with one load has null shares of others.
    """
    return _profile_of(mask_cells(df, contracts, source, load), limits).select("source", "load", _name(contracts), "mask", "n", "share", "share_others", "rare")


def _profile_of(counts: DataFrame, limits: Departures) -> DataFrame:
    """As mask_profile, of (source, load, column, mask, n)."""
    cells = counts.where(F.col("mask").isNotNull())
    loads = cells.groupBy("source", "load", "column").agg(F.sum("n").alias("n_load"))
    whole = cells.groupBy("source", "column").agg(F.sum("n").alias("n_source"))
    masks = cells.groupBy("source", "column", "mask").agg(F.sum("n").alias("n_mask"))
    rest = F.nullif(F.col("n_source") - F.col("n_load"), F.lit(0))
    return (
        cells.alias("c")
        .join(masks.alias("m"), null_safe("c", "m", ["source", "column", "mask"]))
        .join(loads.alias("l"), null_safe("c", "l", ["source", "load", "column"]))
        .join(whole.alias("w"), null_safe("c", "w", ["source", "column"]))
        .select("c.*", "m.n_mask", "l.n_load", "w.n_source")
        .select(
            "source",
            "load",
            "column",
            "mask",
            "n",
            (F.col("n") / F.col("n_load")).alias("share"),
            ((F.col("n_mask") - F.col("n")) / rest).alias("share_others"),
            (F.col("n_mask") < limits.rare_mask * F.col("n_source")).alias("rare"),
        )
    )


def mask_divergence(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, limits: Departures = Departures()) -> DataFrame:
    """Jensen-Shannon divergence (nats, 0 to ln 2) of each load's mask distribution from the source's other loads.

    Null where the source has no other load with texts. ``n_rare`` counts the texts under rare masks.
    """
    p, q = F.col("share"), F.coalesce(F.col("share_others"), F.lit(0.0))
    m = (p + q) / 2
    part = (p * F.ln(p / m) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)) / 2
    return (
        mask_profile(df, contracts, source, load, limits)
        .groupBy("source", "load", "column_name")
        .agg(
            F.sum("n").alias("n_texts"),
            F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("n_rare"),
            F.when(F.count("share_others") > 0, F.sum(part) + (1 - F.sum(q)) * F.lit(0.5) * F.ln(F.lit(2.0))).alias("divergence"),
        )
    )


def _name(contracts: list[ColumnContract]) -> Column:
    return F.element_at(F.array(*(F.lit(c.name) for c in contracts)), F.col("column") + 1).alias("column_name")


def _below(contracts: list[ColumnContract], least: Column) -> Column:
    tests = [F.lit(False)]
    for i, c in enumerate(contracts):
        if c.least is not None:
            tests.append((F.col("column") == i) & ((least <= c.least) if c.strict else (least < c.least)))
    return reduce(lambda a, b: a | b, tests)


def _texts(contracts: list[ColumnContract]) -> Column:
    """Whether the row's column is one of texts."""
    return F.col("column").isin([i for i, c in enumerate(contracts) if c.format is not None])


def _loads_of(counted: DataFrame, contracts: list[ColumnContract]) -> DataFrame:
    """Per load and column, from ``cells``: rows, nulls, unreadable texts, values, least and most."""
    known, number = F.col("mask").isNotNull(), F.col("size").isNotNull()
    return counted.groupBy("source", "load", "column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"),
        F.sum(F.when(_texts(contracts) & known & ~number, F.col("n")).otherwise(0)).alias("n_unreadable"),
        F.sum(F.when(number, F.col("n")).otherwise(0)).alias("n_values"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def _distinct_values(df: DataFrame, contracts: list[ColumnContract], source: str, load: str) -> DataFrame:
    values = _long(df, contracts, source, load, None).where(F.col("number").isNotNull())
    return values.groupBy("source", "load", "column").agg(F.countDistinct("number").alias("n_distinct"))


def load_profile(df: DataFrame, contracts: list[ColumnContract], source: str, load: str) -> DataFrame:
    """Per load and column: rows, nulls, unreadable texts, values, least and most, distinct values."""
    return _with_distinct(_loads_of(cells(df, contracts, source, load), contracts), _distinct_values(df, contracts, source, load))


def _with_distinct(loads: DataFrame, distinct: DataFrame) -> DataFrame:
    joined = loads.alias("c").join(distinct.alias("d"), null_safe("c", "d", ["source", "load", "column"]), "left")
    return joined.select("c.*", F.coalesce("d.n_distinct", F.lit(0)).alias("n_distinct"))


def rare_violations(counted: DataFrame, contracts: list[ColumnContract], limits: Departures = Departures()) -> DataFrame:
    """(source, load, column, n_unreadable): texts of a load under masks that are not dominant in the source's column.

    A mask is dominant if it is not rare there and its texts have the contract's format. What is left is checked: a rare mask
    may still be one of readable texts, such as those of negative numbers.
    """
    merged = counted.where(_texts(contracts)).groupBy("source", "load", "column", "mask").agg(F.sum("n").alias("n"), F.max("size").isNotNull().alias("_readable"))
    told = _profile_of(merged.drop("_readable"), limits)
    readable = merged.where("_readable").select("column", "mask").distinct().withColumn("_readable", F.lit(True))
    judged = told.join(readable, ["column", "mask"], "left").withColumn("_readable", F.coalesce("_readable", F.lit(False)))
    suspects = judged.where(~(~F.col("rare") & F.col("_readable")))
    return suspects.where(~F.col("_readable")).groupBy("source", "load", "column").agg(F.sum("n").alias("n_unreadable"))


_GROUP = ["source", "by", "column"]


def _bucketed(values: DataFrame, hot_rows: int) -> DataFrame | None:
    """Adds bucket, ascending with the number; None if no group is hot. Buckets that are still too large are cut again.

    A value that is several edges at once has as many buckets: its rows, all equal, may be ranked in any order. They are drawn
    by the number ``pick`` that a row has from the scan, so that a task that is run again draws alike.
    """
    out, key = values.withColumn("bucket", F.lit(0).cast("long")), [*_GROUP, "bucket"]
    for cut_no in range(MOST_CUTS):
        edges = bucket_edges(out, key, "number", hot_rows)
        if edges is None:
            return out if cut_no else None
        low = F.size(F.filter("_edges", lambda e: e < F.col("number")))
        ties = F.size(F.filter("_edges", lambda e: e == F.col("number")))
        held = out.alias("v").join(edges.alias("e"), null_safe("v", "e", key), "left").select("v.*", "e._edges")
        drawn = F.pmod(F.xxhash64("pick", F.lit(cut_no)), ties + 1).cast("int")
        out = held.withColumn("bucket", F.col("bucket") * (MOST_BUCKETS + 1) + F.when(F.col("_edges").isNull(), 0).otherwise(low + drawn)).drop("_edges")
    return out


def _ranked(values: DataFrame, limits: Departures) -> DataFrame:
    """Adds bucket (0 but in hot groups), rank (in the group, by number), own (rank among the load's), n_all, n_load, n_most.

    n_most is the largest n_load of the group. Hot groups are cut at approximate quantiles into buckets that are ranked
    alone; counts of the buckets before are added, so ranks stay exact.
    """
    split = _bucketed(values, limits.hot_rows)
    if split is None:
        whole = Window.partitionBy(*_GROUP)
        own = Window.partitionBy(*_GROUP, "load")
        return (
            values.withColumn("bucket", F.lit(0))
            .withColumn("rank", F.row_number().over(whole.orderBy("number", "load")))
            .withColumn("n_all", F.count(F.lit(1)).over(whole))
            .withColumn("own", F.row_number().over(own.orderBy("rank")))
            .withColumn("n_load", F.count(F.lit(1)).over(own))
            .withColumn("n_most", F.max("n_load").over(whole))
        )
    counts = split.groupBy(*_GROUP, "bucket", "load").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = counts.groupBy(*_GROUP, "bucket").agg(F.sum("n").alias("n"))
    by_load = counts.groupBy(*_GROUP, "load").agg(F.sum("n").alias("n_load"))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*_GROUP, *keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_bucket.withColumn("shift", before()).drop("n")
    own_offsets = counts.withColumn("own_shift", before("load")).drop("n")
    sizes = by_load.groupBy(*_GROUP).agg(F.sum("n_load").alias("n_all"), F.max("n_load").alias("n_most"))
    inner = Window.partitionBy(*_GROUP, "bucket")
    return (
        split.withColumn("rank", F.row_number().over(inner.orderBy("number", "load")))
        .withColumn("own", F.row_number().over(Window.partitionBy(*_GROUP, "bucket", "load").orderBy("rank")))
        .alias("r")
        .join(offsets.alias("o"), null_safe("r", "o", [*_GROUP, "bucket"]))
        .join(own_offsets.alias("p"), null_safe("r", "p", [*_GROUP, "bucket", "load"]))
        .join(by_load.alias("l"), null_safe("r", "l", [*_GROUP, "load"]))
        .join(sizes.alias("s"), null_safe("r", "s", _GROUP))
        .select("r.*", "o.shift", "p.own_shift", "l.n_load", "s.n_all", "s.n_most")
        .withColumn("own", F.col("own") + F.col("own_shift"))
        .withColumn("rank", F.col("rank") + F.col("shift"))
    )


def far_bounds(counted: DataFrame, limits: Departures = Departures()) -> DataFrame:
    """(source, by, column, load, least_far, most_far): between how many of the load's values in the group are far.

    Far from the median of the group's values in the other loads, as in far_counts. The mask under which the others' middle
    values lie bounds the median; a mask of the load whose values are all beyond these bounds, or all within, is certain.
    Lists have an entry a mask: some ten a power of ten that the group's values span. A group that no other load has is never
    far.
    """
    own = counted.where(F.col("size").isNotNull()).groupBy(*_GROUP, "load", "size").agg(F.sum("n").alias("n"), F.min("least").alias("lo"), F.max("most").alias("hi"))
    whole = own.groupBy(*_GROUP, "size").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    listed = lambda t, *keys: t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "n", "lo", "hi"))).alias("cells"), F.sum("n").alias("n"))
    o, w = listed(own, *_GROUP, "load").alias("o"), listed(whole, *_GROUP).alias("w")
    both = o.join(w, null_safe("o", "w", _GROUP)).select(
        *(f"o.{k}" for k in (*_GROUP, "load")), F.col("o.cells").alias("own"), F.col("w.cells").alias("whole"), (F.col("w.n") - F.col("o.n")).alias("rest"),
        F.map_from_entries(F.transform("o.cells", lambda c: F.struct(c["size"], c["n"]))).alias("mine"),
    )
    lower, upper = F.floor((F.col("rest") + 1) / 2), F.floor(F.col("rest") / 2) + 1
    none = F.lit(None).cast("double")
    state = lambda c, a, b, x, y: F.struct(c.alias("c"), a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))

    def walk(old: Column, cell: Column) -> Column:
        """c: others so far; a and b: bounds of their lower middle value, x and y: of the upper one."""
        now = old["c"] + cell["n"] - F.coalesce(F.element_at("mine", cell["size"]), F.lit(0))
        reached = lambda k: (old["c"] < k) & (now >= k)
        pick = lambda k, name, kept: F.when(reached(k), cell[name]).otherwise(kept)
        return state(now, pick(lower, "lo", old["a"]), pick(lower, "hi", old["b"]), pick(upper, "lo", old["x"]), pick(upper, "hi", old["y"]))

    middle = both.withColumn("m", F.aggregate("whole", state(F.lit(0).cast("long"), none, none, none, none), walk))
    low, high, factor = (F.col("m.a") + F.col("m.x")) / 2, (F.col("m.b") + F.col("m.y")) / 2, F.lit(limits.far_factor)
    bounded = middle.select(*_GROUP, "load", "own", F.when(F.col("rest") > 0, low).alias("low"), F.when(F.col("rest") > 0, high).alias("high"))
    surely = lambda c: (c["lo"] > F.col("high") * factor) | (c["hi"] < F.col("low") / factor)
    never = lambda c: (c["hi"] <= F.col("low") * factor) & (c["lo"] >= F.col("high") / factor)
    total = lambda test: F.aggregate(F.filter("own", test), F.lit(0).cast("long"), lambda t, c: t + c["n"])
    alone = F.col("low").isNull()
    return bounded.select(
        *_GROUP, "load", F.when(alone, 0).otherwise(total(surely)).alias("least_far"), F.when(alone, 0).otherwise(total(lambda c: ~never(c))).alias("most_far")
    )


def far_counts(values: DataFrame, limits: Departures = Departures()) -> DataFrame:
    """(source, by, column, load, n_far): how many values are far from the exact median of the group's values in the other loads.

    Input: (source, by, column, load, number, pick), the last a number drawn for each row where it was read. Let a value have rank r in its group and rank j within its load, so that r - j
    values of other loads are below it. The k-th value of the others then has rank k + #{r - j < k} in the group, which gives
    the leave-one-out median of every load from two sorts, without pairing loads with values. Only values ranked around the
    middle can be such medians, and only they are looked up.
    """
    ranked = _ranked(values, limits)
    rest = F.col("n_all") - F.col("n_load")
    lower, upper = F.floor((rest + 1) / 2), F.floor(rest / 2) + 1
    under = F.col("rank") - F.col("own")
    whole_load = Window.partitionBy(*_GROUP, "load")
    near = F.abs(2 * F.col("rank") - F.col("n_all")) <= F.col("n_most") + 3
    # one row a load and group, with its values and those of them that may be a median: sorted once, used three times
    loads = cut(
        ranked.where(rest > 0)
        .groupBy(*_GROUP, "load", "bucket")
        .agg(
            F.collect_list("number").alias("numbers"),
            F.collect_list(F.when(near, F.struct(F.col("rank").alias("at"), F.col("number").alias("found")))).alias("middle"),
            F.max(lower).alias("k_lower"),
            F.max(upper).alias("k_upper"),
            F.sum(F.when(under < lower, 1).otherwise(0)).alias("lower"),
            F.sum(F.when(under < upper, 1).otherwise(0)).alias("upper"),
        )
        .withColumn("lower", F.col("k_lower") + F.sum("lower").over(whole_load))
        .withColumn("upper", F.col("k_upper") + F.sum("upper").over(whole_load))
        .drop("k_lower", "k_upper")
    )
    middle = loads.select(*_GROUP, F.explode("middle").alias("m")).select(*_GROUP, "m.*")
    asked = loads.select(*_GROUP, "load", "lower", "upper").distinct().select(*_GROUP, "load", F.explode(F.array("lower", "upper")).alias("at"))
    looked_up = asked.alias("a").join(middle.alias("m"), null_safe("a", "m", [*_GROUP, "at"])).select("a.*", "m.found")
    medians = looked_up.groupBy(*_GROUP, "load").agg((F.sum("found") / F.count("found")).alias("median"))
    m, factor = F.col("median"), F.lit(limits.far_factor)
    far = F.size(F.filter("numbers", lambda v: (v > m * factor) | (v < m / factor)))
    own = loads.drop("middle").alias("l").join(medians.alias("m"), null_safe("l", "m", [*_GROUP, "load"])).select("l.*", "m.median")
    return own.withColumn("far", far).groupBy(*_GROUP, "load").agg(F.sum("far").alias("n_far"))


def _drawn(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None) -> DataFrame:
    """The numbers of the columns, each with a ``pick``: drawn from the rows of the scan, before anything is shuffled."""
    return _long(df, contracts, source, load, by).withColumn("pick", F.rand(7)).where(F.col("number").isNotNull())


def _far_loads(df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None, counted: DataFrame, limits: Departures) -> DataFrame:
    """(source, load, column): the loads of which at least ``far_share`` of the values are far; bounds first, then exact ranks."""
    key = ["source", "load", "column"]
    groups = cut(far_bounds(counted, limits))
    n = counted.groupBy(*key).agg(F.sum(F.when(F.col("size").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"))
    sums = groups.groupBy(*key).agg(F.sum("least_far").alias("least_far"), F.sum("most_far").alias("most_far"))
    enough = F.col("n_values") * limits.far_share
    loads = cut(sums.alias("s").join(n.alias("n"), null_safe("s", "n", key)).select("s.*", "n.n_values").where(F.col("most_far") >= enough))
    certain = loads.where(F.col("least_far") >= enough).select(*key)
    open_loads = loads.where(F.col("least_far") < enough)
    if not open_loads.take(1):
        return certain
    unsure = cut(groups.where("most_far > least_far").alias("g").join(open_loads.select(*key).alias("l"), null_safe("g", "l", key), "left_semi"))
    values = _drawn(df, contracts, source, load, by)
    theirs = values.alias("v").join(unsure.select(*_GROUP).distinct().alias("u"), null_safe("v", "u", _GROUP), "left_semi")
    exact = far_counts(theirs.select(*_GROUP, "load", "number", "pick"), limits)
    gained = (
        unsure.alias("u").join(exact.alias("e"), null_safe("u", "e", [*_GROUP, "load"]), "left")
        .select(*(f"u.{k}" for k in key), (F.coalesce("e.n_far", F.lit(0)) - F.col("u.least_far")).alias("more"))
        .groupBy(*key).agg(F.sum("more").alias("more"))
    )
    found = open_loads.alias("o").join(gained.alias("g"), null_safe("o", "g", key)).where(F.col("o.least_far") + F.col("g.more") >= F.col("o.n_values") * limits.far_share)
    return certain.unionByName(found.select(*(f"o.{k}" for k in key)))


def departures(
    df: DataFrame, contracts: list[ColumnContract], source: str, load: str, by: str | None = None, limits: Departures = Departures()
) -> DataFrame:
    """The loads and columns that depart: (source, load, column_name, issue), one row per issue.

    Issues: null_rate, pattern, range, distribution, distinct. Repeated rows count as often as they come. A source with a
    single load has no others, so only pattern and range can be found there; an empty table gives no rows; NaN counts as
    neither null nor value; a null source, load or ``by`` is one of its own. Columns besides those named are not read.
    """
    counted = cut(cells(df, contracts, source, load, by))
    key = ["source", "load", "column"]
    profile, far = together(
        lambda: cut(_with_distinct(_loads_of(counted, contracts), _distinct_values(df, contracts, source, load))),
        lambda: _far_loads(df, contracts, source, load, by, counted, limits),
    )
    rare = rare_violations(counted, contracts, limits)
    whole = profile.groupBy("source", "column").agg(*(F.sum(c).alias(f"{c}_all") for c in ("n_rows", "n_null", "n_values", "n_distinct")))
    others = lambda c: F.col(f"{c}_all") - F.col(c)
    share = lambda a, b: F.try_divide(a, b)
    tests = {
        "null_rate": share(F.col("n_null"), F.col("n_rows")) - share(others("n_null"), others("n_rows")) >= limits.null_rate,
        "range": _below(contracts, F.col("least")),
        "distinct": share(F.col("n_distinct"), F.col("n_values")) < limits.distinct * share(others("n_distinct"), others("n_values")),
    }
    issues = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    told = profile.alias("p").join(whole.alias("w"), null_safe("p", "w", ["source", "column"])).select("p.*", *(f"w.{c}" for c in whole.columns if c.endswith("_all"))).select(*key, F.explode(issues).alias("issue"))
    named = lambda df, issue: df.select(*key, F.lit(issue).alias("issue"))
    return told.unionByName(named(rare, "pattern")).unionByName(named(far, "distribution")).select("source", "load", _name(contracts), "issue")
