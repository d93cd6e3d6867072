"""Ordered-group operators (W-01 to W-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.functions import text as tx
from lectio.operators import scan
from lectio.sources.shared import written_once


#: Rows of a lecture that are compared where they lie, as an array.
NOVELTY_SHORT = 32
#: Rows of a lecture that one task compares with as many earlier ones.
NOVELTY_ROWS = 4096
#: A token that more rows of a long lecture hold is a frequent one.
NOVELTY_RARE = 64
# Fixed values.
#: The most recent elements that a prompt carries, and the shortest name of an element.
DESCRIBED_WINDOW, ELEMENT_LENGTH = 40, 4
#: Words that say where a thing is or what kind it is, never what it is.
STRUCTURAL = (
    "figure", "figures", "slide", "slides", "table", "tables", "chart", "charts", "diagram", "image", "picture", "graph", "text", "title",
    "page", "section", "part", "chapter", "left", "right", "top", "bottom", "centre", "center", "middle", "above", "below", "next",
    "example", "overview", "summary", "introduction", "conclusion", "outline", "lecture",
)
NOTHING_DESCRIBED = "(nothing yet — this is the first described moment of the lecture)"


def _best_class(table):
    """For each asking row of a block: the greatest overlap with a class whose first row is earlier.

    Classes are tried from the highest bound down, which the numbers of frequent tokens and the sizes give;
    a row stops at the first class that can't beat its best.
    """
    import numpy as np
    import pyarrow as pa

    ask = table.column("_ask").to_numpy()
    at, n = table.column("_at").to_numpy(), table.column("_n").to_numpy()
    lists = table.column("_c").combine_chunks()
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    held = np.diff(edges)
    classes = np.flatnonzero(~ask)
    asking = np.flatnonzero(ask)
    most = np.zeros(len(asking))
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    flat = np.concatenate([codes[edges[c] : edges[c + 1]] for c in classes]) if len(classes) else codes[:0]
    starts = np.cumsum(held[classes]) - held[classes]
    for k, i in enumerate(asking.tolist()):
        earlier = at[classes] < at[i]
        shared = np.minimum(held[i], held[classes])
        bound = np.where(earlier, shared / (n[i] + n[classes] - shared), 0.0)
        order = np.argsort(-bound, kind="stable")
        mine = codes[edges[i] : edges[i + 1]]
        mark[mine] = True
        best, done, step = 0.0, 0, 16
        while done < len(order) and bound[order[done]] > best:
            part = order[done : done + step]
            if len(part) > 2048:
                both = np.add.reduceat(mark[flat].astype(np.int64), starts)[part]
            else:
                both = np.array([mark[flat[starts[c] : starts[c] + held[classes[c]]]].sum() for c in part])
            share = np.where(earlier[part], both / (n[i] + n[classes[part]] - both), 0.0)
            best = max(best, float(share.max(initial=0.0)))
            done, step = done + step, step * 4
        mark[mine] = False
        most[k] = best
    return pa.table({"_seq_of": table.column(0).take(pa.array(asking)), "_at": at[asking], "_most": most})


def _most_overlap(table):
    """For each later row of a pair of blocks: the greatest token overlap with an earlier row of the other block."""
    import numpy as np
    import pyarrow as pa

    at = table.column("_at").to_numpy()
    before = table.column("_before").to_numpy()  # 0: the one block of the pair; 1: the later one; -1: the earlier one
    sets = table.column("_set").combine_chunks()
    codes = sets.flatten().dictionary_encode().indices.to_numpy()
    edges = sets.offsets.to_numpy() - sets.offsets[0].as_py()
    sizes = np.diff(edges)
    earlier = np.flatnonzero(before <= 0)
    row_of = np.full(len(at), -1)
    row_of[earlier] = np.arange(len(earlier))
    owner = np.repeat(row_of, sizes)
    order = np.argsort(codes, kind="stable")
    order = order[owner[order] >= 0]
    begins = np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2))
    postings = owner[order]
    place, weight = at[earlier], sizes[earlier]
    later = np.flatnonzero(before >= 0)
    most = np.zeros(len(later))
    for k, i in enumerate(later.tolist()):
        tokens = codes[edges[i] : edges[i + 1]]
        lists = [postings[begins[t] : begins[t + 1]] for t in tokens.tolist()]
        if lists:
            both = np.bincount(np.concatenate(lists), minlength=len(earlier))
            share = both / np.maximum(sizes[i] + weight - both, 1)
            most[k] = share[place < at[i]].max(initial=0.0)
    return pa.table({"_seq_of": table.column(0).take(pa.array(later)), "_at": at[later], "_most": most})


def _numbered(rows: DataFrame, keys: list[str], order: list[str], text: str, name: str) -> DataFrame:
    """Rows with their number in the group, by order and then by a hash of the text."""
    return scan.scan(rows.withColumn("_tie", F.xxhash64(text)), keys, [*order, "_tie"], **{name: scan.number()}).drop("_tie")


def _in_arrays(numbered: DataFrame, lecture: str) -> DataFrame:
    """(lecture, _at, _most) of rows (lecture, _at, _set) of short lectures: each one's rows are an array, compared by native functions."""
    both = lambda x, y: tx.bound(F.size(F.array_intersect(x["_set"], y["_set"])), lambda n: n / F.greatest(F.size(x["_set"]) + F.size(y["_set"]) - n, F.lit(1)))
    best = lambda x: F.aggregate("_rs", F.lit(0.0), lambda most, y: F.when(y["_at"] < x["_at"], F.greatest(most, both(x, y))).otherwise(most))
    listed = numbered.groupBy(lecture).agg(F.collect_list(F.struct("_at", "_set")).alias("_rs"))
    return listed.select(lecture, F.explode(F.transform("_rs", lambda x: F.struct(x["_at"].alias("_at"), best(x).alias("_most")))).alias("_m")).select(lecture, "_m.*")


def _in_blocks(numbered: DataFrame, lecture: str, kind: str) -> DataFrame:
    """(lecture, _at, _most) of rows (lecture, _at, _set): every row against all earlier ones, a pair of blocks in a task."""
    block = F.floor((F.col("_at") - 1) / NOVELTY_ROWS).cast("int").alias("_block")
    cut = numbered.select(lecture, "_at", "_set", block)
    ends = cut.groupBy(lecture).agg(F.max("_block").alias("_last"))
    own = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda b: F.struct(F.greatest(b, F.col("_block")).alias("_later"), F.least(b, F.col("_block")).alias("_earlier"), F.signum(F.col("_block") - b).cast("int").alias("_before")))
    dealt = cut.join(ends, lecture).select(lecture, "_at", "_set", F.explode(own).alias("_p")).select(lecture, "_at", "_set", "_p.*")
    found = dealt.groupBy(lecture, "_later", "_earlier").applyInArrow(_most_overlap, f"_seq_of {kind}, _at int, _most double")
    return found.groupBy(F.col("_seq_of").alias(lecture), "_at").agg(F.max("_most").alias("_most"))


def _by_index(numbered: DataFrame, lecture: str, kind: str, rare: int) -> DataFrame:
    """(lecture, _at, _most) of rows (lecture, _at, _set): every row against the earlier ones that can be its best.

    Two rows share a token that at most ``rare`` rows of the lecture hold, or frequent ones only.
    Pairs of the first kind come from the rare tokens' short lists, with the number of rare tokens that both hold;
    only those that can still beat a row's best so far have their frequent tokens compared. For the second kind all rows
    with the same frequent tokens and the same size are alike, so a row meets the first of each such class, and
    only if its frequent tokens alone can beat what it has.
    """
    key = [lecture, "_at"]
    tokens = numbered.select(*key, F.size("_set").alias("_n"), F.explode("_set").alias("_t"))
    often = tokens.groupBy(lecture, "_t").agg(F.count("*").alias("_f")).where(F.col("_f") > rare).select(lecture, "_t")
    flagged = tokens.join(often.withColumn("_often", F.lit(True)), [lecture, "_t"], "left")
    common = F.array_sort(F.collect_list(F.when(F.col("_often"), F.col("_t")))).alias("_c")
    split = flagged.groupBy(*key, "_n").agg(common)
    lists = flagged.where("_often IS NULL").groupBy(lecture, "_t").agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_ls")).where(F.size("_ls") > 1)
    pair = F.flatten(F.transform("_ls", lambda x, i: F.transform(F.slice("_ls", i + 2, F.size("_ls")), lambda y: F.struct(x["_at"].alias("_a"), x["_n"].alias("_m"), y["_at"].alias("_at"), y["_n"].alias("_n")))))
    pairs = lists.select(lecture, F.explode(pair).alias("_p")).groupBy(lecture, "_p").agg(F.count("*").alias("_r")).select(lecture, "_p.*", "_r")
    side = split.select(lecture, F.col("_at").alias("_a"), F.col("_c").alias("_d"))
    sized = pairs.join(split.select(*key, "_c"), key).withColumn("_least", F.col("_r") / (F.col("_n") + F.col("_m") - F.col("_r")))
    most = F.col("_r") + F.least(F.size("_c"), F.col("_m") - F.col("_r"))
    bound = F.max("_least").over(Window.partitionBy(*key))
    hopeful = sized.withColumn("_bound", bound).where(most / (F.col("_n") + F.col("_m") - most) >= F.col("_bound"))
    overlap = F.col("_r") + F.size(F.array_intersect("_c", "_d"))
    by_rare = hopeful.join(side, [lecture, "_a"]).groupBy(*key).agg(F.max(overlap / (F.col("_n") + F.col("_m") - overlap)).alias("_most"))
    asking = split.where(F.size("_c") > 0).join(by_rare, key, "left").where(F.size("_c") / F.col("_n") > F.coalesce("_most", F.lit(0.0)))
    classes = split.where(F.size("_c") > 0).groupBy(lecture, "_n", "_c").agg(F.min("_at").alias("_at"))
    classes = scan.scan(classes, [lecture], ["_at"], _k=scan.number())
    block = lambda c: F.floor((F.col(c) - 1) / NOVELTY_ROWS).cast("int")
    heads = classes.groupBy(lecture, block("_k").alias("_cb")).agg(F.min("_at").alias("_from"))
    asked = asking.select(*key, "_n", "_c", block("_at").alias("_qb"))
    ends = asked.groupBy(lecture, "_qb").agg(F.max("_at").alias("_to"))
    met = heads.join(ends, lecture).where("_from < _to").select(lecture, "_qb", "_cb")
    columns = lambda df, ask: df.select(lecture, "_qb", "_cb", "_at", "_n", "_c", F.lit(ask).alias("_ask"))
    dealt = columns(asked.join(met, [lecture, "_qb"]), True).unionByName(columns(classes.withColumn("_cb", block("_k")).join(met, [lecture, "_cb"]), False))
    by_often = dealt.groupBy(lecture, "_qb", "_cb").applyInArrow(_best_class, f"_seq_of {kind}, _at int, _most double").withColumnRenamed("_seq_of", lecture)
    nothing = numbered.select(*key, F.lit(0.0).alias("_most"))
    return by_rare.unionByName(by_often).unionByName(nothing).groupBy(*key).agg(F.max("_most").alias("_most"))


def within_lecture_novelty(rows: DataFrame, lecture: str, order: list[str], text: str, among: Column | None = None, block: int = NOVELTY_ROWS, rare: int = NOVELTY_RARE, short: int = NOVELTY_SHORT) -> DataFrame:
    """W-01, J-03: ``novelty``: one less the greatest token overlap with any earlier row of the lecture; first: 1.

    A lecture of at most ``short`` rows is compared as an array, one of at most ``block`` rows in one task, over the lists of
    rows that hold a token. A longer one goes by an index of rare tokens and by classes of rows that are alike in the frequent ones, so
    that a token which every row has makes no pairs. Rows outside ``among`` get a null novelty and count for no
    other row. Rows of equal order follow a hash of their text.
    """
    chosen = F.lit(True) if among is None else among
    kind = dict(rows.dtypes)[lecture]
    keyed = _numbered(rows.withColumn("_in", chosen), [lecture, "_in"], order, text, "_at").withColumn("_at", F.when(F.col("_in"), F.col("_at"))).drop("_in")
    numbered = keyed.where(F.col("_at").isNotNull()).select(lecture, "_at", tx.token_set(text).alias("_set"))
    sizes = numbered.groupBy(lecture).agg(F.max("_at").alias("_size"))
    sized = written_once(numbered.join(sizes, lecture), "token-sets")
    longest = sized.agg(F.max("_size")).first()[0] or 0
    columns = lambda condition: sized.where(condition).select(lecture, "_at", "_set")
    few = min(short, block)
    most = _in_arrays(columns(F.col("_size") <= few), lecture)
    if longest > few:
        most = most.unionByName(_in_blocks(columns((F.col("_size") > few) & (F.col("_size") <= block)), lecture, kind))
    if longest > block:
        most = most.unionByName(_by_index(columns(F.col("_size") > block), lecture, kind, rare))
    return keyed.join(most, [lecture, "_at"], "left").withColumn("novelty", 1 - F.col("_most")).drop("_at", "_most")


def ranks(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """W-12: position by falling value; ties keep the order of ``ordinal``; rows without a value come last."""
    keyed = df.withColumns({"_group": F.lit(0), "_none": F.col(value).isNull().cast("int"), "_falling": -F.col(value)})
    return scan.scan(keyed, by or ["_group"], ["_none", "_falling", ordinal], position=scan.number()).drop("_group", "_none", "_falling")


def gaps_between(speech: DataFrame, lecture: str, durations: DataFrame, minimum: float = 0.5) -> DataFrame:
    """W-06: silences around speech, before the first and after the last included; two digits."""
    ends = durations.select(lecture, F.col("duration").alias("start"), F.col("duration").alias("end"))
    line = scan.scan(speech.select(lecture, "start", "end").unionByName(ends), [lecture], ["start", "end"], _from=scan.max_before("end"))
    line = line.withColumn("_from", F.greatest(F.coalesce("_from", F.lit(0.0)), F.lit(0.0)))
    return line.where(F.col("start") - F.col("_from") >= minimum).select(lecture, F.round("_from", 2).alias("start"), F.round("start", 2).alias("end"))


def usable_gaps(gaps: DataFrame, minimum: float = 1.5) -> DataFrame:
    """PRJ-16."""
    return gaps.where(F.col("end") - F.col("start") >= minimum)


def next_event_span(rows: DataFrame, lecture: str, t: str, before: float = 5.0, cap: float = 45.0) -> DataFrame:
    """W-11: ``low``, ``high`` of the window that ends with the next event or the cap."""
    capped = F.col(t) + cap
    next_t = F.col("_next")
    high = F.when((next_t > F.col(t)) & (next_t < capped), next_t).otherwise(capped)
    return scan.scan(rows, [lecture], [t], _next=scan.lead(t)).withColumn("low", F.col(t) - before).withColumn("high", high).drop("_next")


def keyframe_times(duration: Column, scenes: Column, interval: float = 30.0, min_gap: float = 5.0) -> Column:
    """W-08: the grid and the scene times in order, each at least ``min_gap`` after the one kept before it."""
    grid = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(duration, F.lit(0.0)) / interval).cast("int")), lambda i: i.cast("double") * interval)
    times = F.filter(F.array_sort(F.array_distinct(F.concat(grid, F.coalesce(scenes, F.array().cast("array<double>"))))), lambda x: (x >= 0) & (x < duration))
    start = F.array().cast("array<double>")
    return F.aggregate(times, start, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= min_gap), F.concat(kept, F.array(x))).otherwise(kept))


def described_terms(text: str, slide: str | None = None) -> Column:
    """W-09: what a description names: its first content terms that aren't short or structural and, if there is a slide, stand among the slide's."""
    named = F.filter(tx.content_terms(text, DESCRIBED_WINDOW), lambda t: (F.length(t) >= ELEMENT_LENGTH) & ~F.lower(t).isin(*STRUCTURAL))
    if slide is None:
        return named
    shown = F.array(F.transform(tx.content_terms(slide, 80), F.lower))
    on_slide = F.element_at(F.transform(shown, lambda s: F.filter(named, lambda t: F.array_contains(s, F.lower(t)))), 1)
    return F.when(F.coalesce(F.col(slide), F.lit("")) == "", named).otherwise(on_slide)


def described_so_far(rows: DataFrame, lecture: str, writer: str, order: list[str], text: str, slide: str | None = None, emit: str | None = None, window: int = DESCRIBED_WINDOW) -> DataFrame:
    """W-09, W-10: what was described in the lecture before each row, and what the row adds.

    ``described``: the last ``window`` elements named before the row, in the order in which they came and as first
    spelled; ``new_elements``: those that the row is the first to name; ``elements_so_far``: how many there are with
    it. A row that isn't to be emitted, or whose text is blank, adds nothing.

    First mentions are found by an aggregation and numbered by a segmented scan; a row's list is the range of
    numbers that ends before its own, so no row gathers more than ``window`` elements, nor a task a lecture.
    """
    keys = [lecture, writer]
    there = F.col(emit) if emit else F.lit(True)
    none = F.array().cast("array<string>")
    keyed = scan.scan(rows, keys, order, _at=scan.number())
    said = keyed.select(*keys, "_at", F.posexplode(F.when(F.coalesce(there, F.lit(False)), described_terms(text, slide)).otherwise(none)).alias("_pos", "_term"))
    first = said.groupBy(*keys, F.lower("_term").alias("_key")).agg(F.min(F.struct("_at", "_pos", "_term")).alias("_first")).select(*keys, "_first.*")
    numbered = scan.scan(first, keys, ["_at", "_pos"], _n=scan.number())
    new = numbered.groupBy(*keys, "_at").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_term"))), lambda x: x["_term"]).alias("new_elements"), F.max("_n").alias("_upto"))
    counted = scan.scan(keyed.join(new, [*keys, "_at"], "left"), keys, ["_at"], _seen=scan.last("_upto"))
    counted = counted.withColumn("new_elements", F.coalesce("new_elements", none)).withColumn("elements_so_far", F.coalesce("_seen", F.lit(0)))
    counted = counted.withColumn("_before", F.col("elements_so_far") - F.size("new_elements"))
    wanted = counted.where("_before > 0").select(*keys, "_at", F.explode(F.sequence(F.greatest(F.col("_before") - window + 1, F.lit(1)), F.col("_before"))).alias("_n"))
    listed = wanted.join(numbered.select(*keys, "_n", "_term"), [*keys, "_n"]).groupBy(*keys, "_at").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_term"))), lambda x: x["_term"]).alias("described"))
    out = counted.join(listed, [*keys, "_at"], "left").withColumn("described", F.coalesce("described", none))
    return out.select(*rows.columns, "described", "new_elements", "elements_so_far")


def described_text(described: str | Column = "described") -> Column:
    """W-09: the elements as a prompt carries them; a sentence where there are none."""
    listed = F.col(described) if isinstance(described, str) else described
    return F.when(F.size(listed) == 0, F.lit(NOTHING_DESCRIBED)).otherwise(F.array_join(listed, "; "))


def first_row_per(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """W-16: the first row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), ordinal).alias("_r")).select(key, "_r.*")


def batches(rows: DataFrame, lecture: str, order: list[str], size: int) -> DataFrame:
    """D-21: ``batch`` number within the lecture, at most ``size`` rows each."""
    return scan.scan(rows, [lecture], order, batch=scan.number()).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))
