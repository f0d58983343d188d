"""Questions about programs: names, views, callers, listings, neighbourhoods, call depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinbuild.plans.model import Model
from twinbuild.plans.store import stored, stored_together

ZOOMS = ("intent", "domain", "detail")
KEY = ["program_id", "func_id"]


def program_info(model: Model) -> DataFrame:
    counts = model.functions.groupBy("program_id").agg(F.count("*").alias("function_count"))
    return model.programs.join(counts, "program_id", "left").select("program_id", "name", "language", F.coalesce("function_count", F.lit(0)).alias("function_count"))


def first_fact(model: Model, kind: str, out: str) -> DataFrame:
    """The first fact of a kind on each function."""
    return model.facts.where(F.col("kind") == kind).groupBy("program_id", F.col("target").alias("func_id")).agg(F.min_by("value", "fact_seq").alias(out))


def display_names(model: Model) -> DataFrame:
    """(program_id, func_id, func_seq, display_name): the first rename, else the symbol."""
    return model.functions.select(*KEY, "func_seq", "name").join(first_fact(model, "rename", "_new"), KEY, "left").select(*KEY, "func_seq", F.coalesce("_new", "name").alias("display_name"))


def _calls(model: Model) -> DataFrame:
    """Distinct calls, with the first place of each."""
    return model.call_edges.groupBy("program_id", "src_id", "dst_id").agg(F.min("edge_seq").alias("edge_seq"))


def function_views(model: Model, zoom: str = "domain") -> DataFrame:
    """A function at a zoom; what the zoom withholds is null. Name lists are made only for zooms that show them."""
    if zoom not in ZOOMS:
        raise ValueError(f"zoom must be one of {ZOOMS}")
    names, calls = display_names(model), _calls(model)
    n_callers = calls.groupBy("program_id", F.col("dst_id").alias("func_id")).agg(F.count("*").alias("n_callers"))
    out = model.functions.select(*KEY, "func_seq", "addr", "size", "bb_count", "out_degree").join(names.select(*KEY, "display_name"), KEY).join(n_callers, KEY, "left")
    summary = F.format_string("%s — %d block(s), %d out-call(s), %d caller(s)", "display_name", "bb_count", "out_degree", F.coalesce("n_callers", F.lit(0)))
    if zoom == "intent":
        callees = callers = F.lit(None).cast("array<string>")
    else:
        named = names.select("program_id", "func_id", "func_seq", "display_name")
        called = calls.join(named.withColumnRenamed("func_id", "dst_id"), ["program_id", "dst_id"]).groupBy("program_id", F.col("src_id").alias("func_id")).agg(F.array_sort(F.collect_list(F.struct("edge_seq", "display_name"))).alias("_callees"))
        calling = calls.join(named.withColumnRenamed("func_id", "src_id"), ["program_id", "src_id"]).groupBy("program_id", F.col("dst_id").alias("func_id")).agg(F.array_sort(F.collect_list(F.struct("func_seq", "display_name"))).alias("_callers"))
        out = out.join(called, KEY, "left").join(calling, KEY, "left")
        none = F.array().cast("array<string>")
        callees, callers = F.coalesce("_callees.display_name", none), F.coalesce("_callers.display_name", none)
    shown = zoom != "intent"
    only = lambda c, when: F.col(c) if when else F.lit(None).cast(dict(out.dtypes)[c])
    return out.select(*KEY, "func_seq", F.col("display_name").alias("name"), summary.alias("summary"), only("addr", shown).alias("addr"), only("bb_count", shown).alias("bb_count"), callees.alias("callees"), callers.alias("callers"), only("size", zoom == "detail").alias("size"))


def view(model: Model, ids: DataFrame, zoom: str = "domain") -> DataFrame:
    """Views of (program_id, func_id); an id that does not exist is there with found = false."""
    return ids.select(*KEY).distinct().join(function_views(model, zoom).withColumn("found", F.lit(True)), KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_functions(model: Model, zoom: str = "intent") -> DataFrame:
    return function_views(model, zoom).orderBy("program_id", "name", "func_id")


def search(model: Model, query: str, zoom: str = "intent", in_summary: bool = False) -> DataFrame:
    """Functions whose display name (or summary) holds the query as it stands, in any case; all for an empty one."""
    holds = lambda c: F.contains(F.lower(c), F.lower(F.lit(query)))
    return function_views(model, zoom).where(holds("name") | holds("summary") if in_summary else holds("name")).orderBy("program_id", "name", "func_id")


def callers(model: Model, ids: DataFrame | None = None) -> DataFrame:
    """(program_id, func_id, caller_id, caller_name), sorted by name; with ids, those that do not exist have found = false."""
    names = display_names(model).select("program_id", F.col("func_id").alias("caller_id"), F.col("display_name").alias("caller_name"))
    rows = _calls(model).select("program_id", F.col("dst_id").alias("func_id"), F.col("src_id").alias("caller_id")).join(names, ["program_id", "caller_id"])
    if ids is not None:
        asked = ids.select(*KEY).distinct().join(model.functions.select(*KEY, F.lit(True).alias("found")), KEY, "left")
        rows = asked.join(rows, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return rows.orderBy("program_id", "func_id", "caller_name", "caller_id")


def annotated_views(model: Model, zoom: str = "domain") -> DataFrame:
    return function_views(model, zoom).join(first_fact(model, "comment", "comment"), KEY, "left").join(first_fact(model, "retype", "user_type"), KEY, "left")


_ROW = (1 << 33) - 1  # of monotonically_increasing_id: the row within its partition


def numbered(rows: DataFrame, group: str | tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """rows with their place (from 0) in their group by `order`, which tells the rows of a group apart.

    A range partition of all rows is stored; rows per partition and group, added up, say where each partition's part of a
    group begins. So a group is spread over as many tasks as it fills, and no window sorts it in one.
    """
    group = (group,) if isinstance(group, str) else group
    table = stored(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_ROW))
    sizes = table.groupBy(*group, part).agg(F.min(row).alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")  # as many rows as a group has partitions
    skip = stored(sizes.select(*group, "_part", (before - F.col("_first")).alias("_skip")), "number-offsets")
    placed = table.withColumn("_part", part).join(skip, [*group, "_part"])
    return placed.withColumn(name, row + F.col("_skip")).drop("_at", "_part", "_skip")


def in_chunks(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], most: int = 1_000) -> DataFrame:
    """(group, chunk, n, entries): each group's rows by `order` as lists of at most `most`, numbered from 0; see `numbered`."""
    entry = F.struct(*(c for c in rows.columns if c not in group))
    placed = numbered(rows, group, order, "_place").groupBy(*group, F.floor(F.col("_place") / most).alias("chunk"))
    out = placed.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_place", entry.alias("e")))).alias("_l"))
    return out.withColumn("entries", F.col("_l.e")).drop("_l")


def caller_chunks(model: Model, most: int = 1_000) -> DataFrame:
    """(program_id, func_id, chunk, n, callers): the names of each function's callers in their order, at most `most` a row, so that a hub has many."""
    names = display_names(model).select("program_id", F.col("func_id").alias("caller_id"), "func_seq", "display_name")
    calls = _calls(model).select("program_id", F.col("dst_id").alias("func_id"), F.col("src_id").alias("caller_id")).join(names, ["program_id", "caller_id"])
    return in_chunks(calls, ("program_id", "func_id"), ("func_seq", "caller_id"), most).withColumn("callers", F.col("entries.display_name")).drop("entries")


def listing(model: Model) -> DataFrame:
    """(program_id, line, func_id, addr, name, text): functions by address and name, lines from 0."""
    names = model.functions.select(*KEY, "addr").join(display_names(model).select(*KEY, F.col("display_name").alias("name")), KEY)
    names = numbered(names, "program_id", ("addr", "name", "func_id"), "line")
    digits = F.lower(F.conv(F.col("addr").cast("string"), 10, 16))
    padded = F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)
    return names.select("program_id", "line", "func_id", "addr", "name", F.concat(F.lit("0x"), padded, F.lit("  "), "name").alias("text"))


def references(model: Model, ids: DataFrame | None = None) -> DataFrame:
    """Callers with their lines in the listing."""
    lines = listing(model).select("program_id", F.col("func_id").alias("caller_id"), "line")
    return callers(model, ids).join(lines, ["program_id", "caller_id"], "left" if ids is not None else "inner")


def symbol_search(model: Model, query: str) -> DataFrame:
    return listing(model).where(F.contains(F.lower("name"), F.lower(F.lit(query))))


def neighbourhood(model: Model, ids: DataFrame) -> DataFrame:
    """(program_id, focus, src_id, dst_id, src_name, dst_name): the calls into and out of each id."""
    asked, calls = ids.select("program_id", F.col("func_id").alias("focus")).distinct(), _calls(model).drop("edge_seq")
    near = calls.join(asked, (calls["program_id"] == asked["program_id"]) & (calls["src_id"] == asked["focus"])).select(calls["program_id"], "focus", "src_id", "dst_id")
    into = calls.join(asked, (calls["program_id"] == asked["program_id"]) & (calls["dst_id"] == asked["focus"])).select(calls["program_id"], "focus", "src_id", "dst_id")
    names = display_names(model)
    of = lambda side: names.select("program_id", F.col("func_id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name"))
    return near.unionByName(into).distinct().join(of("src"), ["program_id", "src_id"]).join(of("dst"), ["program_id", "dst_id"])


ENDLESS = 1 << 50  # the depth of what is on a cycle or behind one; any path added to it stays beyond half of it


def _jumped(hung: DataFrame) -> DataFrame:
    """hung (program_id, id, p, floor, w), where depth(id) = max(floor, depth(p) + w), with p moved up to one that hangs from nothing.

    Pointer doubling: every round each takes over its p's p, so n steps take log n rounds. What still moves then goes round in a cycle.
    """
    rounds = max(hung.count(), 1).bit_length() + 1
    up = ["program_id", F.col("id").alias("p"), F.col("p").alias("_p"), F.col("floor").alias("_floor"), F.col("w").alias("_w")]
    for _ in range(rounds):
        moved = hung.join(hung.select(*up), ["program_id", "p"], "left")
        further = F.col("_p").isNotNull()
        floor = F.when(further, F.least(F.greatest("floor", F.col("_floor") + F.col("w")), F.lit(ENDLESS))).otherwise(F.col("floor"))
        hung = stored(moved.select("program_id", "id", F.coalesce("_p", "p").alias("p"), floor.alias("floor"), F.when(further, F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"), further.alias("moved")), "hung")
        if hung.where("moved").isEmpty():
            return hung.drop("moved")
        hung = hung.drop("moved")
    still = hung.join(hung.select("program_id", F.col("id").alias("p"), F.lit(True).alias("_on")), ["program_id", "p"], "left")
    return stored(still.select("program_id", "id", "p", F.when(F.col("_on"), F.lit(ENDLESS)).otherwise(F.col("floor")).alias("floor"), "w"), "hung")


def call_depth(model: Model, most_rounds: int = 100_000) -> DataFrame:
    """(program_id, func_id, depth, cyclic): longest call path from a function that none calls.

    Each round takes out functions that wait for no caller (their depth is known) and those that wait for one only:
    theirs is max(floor, depth of that caller + w), which (max, +) composes along chains by pointer doubling. Calls of both kinds
    are moved on to what is left, so chains and trees of any length end after a few rounds. What is then left, each with two callers or more that wait
    too, is on a cycle or behind one, as is a function that its own chain calls; those have no depth and cyclic = true. Self-calls do not count.
    """
    edges = model.call_edges.where("src_id <> dst_id").select("program_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit(1).cast("long").alias("w")).distinct()
    nodes = model.functions.select("program_id", F.col("func_id").alias("id"), F.lit(0).cast("long").alias("floor"))
    edges, nodes = stored_together((edges, "calls"), (nodes, "waiting"))
    known, hanging = [], []
    for _ in range(most_rounds):
        waits = edges.groupBy("program_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        here = stored(nodes.join(waits, ["program_id", "id"], "left"), "waiting")
        free = here.where(F.col("n").isNull() | (F.col("floor") >= ENDLESS)).select("program_id", "id", F.col("floor").alias("depth"))
        if here.isEmpty():
            break
        known.append(free)
        # known depths become floors of whom they call
        ends = free.select("program_id", F.col("id").alias("src"), "depth")
        given = edges.join(ends, ["program_id", "src"]).groupBy("program_id", F.col("dst").alias("id")).agg(F.max(F.least(F.col("depth") + F.col("w"), F.lit(ENDLESS))).alias("_given"))
        open_edges = edges.join(ends, ["program_id", "src"], "left_anti").join(free.select("program_id", F.col("id").alias("dst")), ["program_id", "dst"], "left_anti")
        rest = here.join(free, ["program_id", "id"], "left_anti").join(given, ["program_id", "id"], "left")
        rest, open_edges = stored_together((rest.select("program_id", "id", F.greatest("floor", "_given").alias("floor")), "waiting"), (open_edges, "calls"))
        one = open_edges.groupBy("program_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("p"), F.max("w").alias("w")).where("n = 1")
        hung = stored(rest.join(one, ["program_id", "id"]).select("program_id", "id", "p", "floor", "w"), "hung")
        if hung.isEmpty():
            if free.isEmpty():
                known.append(rest.select("program_id", "id", F.lit(ENDLESS).alias("depth")))
                break
            edges, nodes = open_edges, rest
            continue
        hung = _jumped(hung)
        hanging.append(hung)
        heads = rest.join(hung.select("program_id", "id"), ["program_id", "id"], "left_anti")
        over = hung.select("program_id", F.col("id").alias("src"), "p", F.col("floor").alias("_floor"), F.col("w").alias("_w"))
        moved = open_edges.join(heads.select("program_id", F.col("id").alias("dst")), ["program_id", "dst"], "left_semi").join(over, ["program_id", "src"], "left")
        moved = stored(moved.select("program_id", "dst", F.coalesce("p", "src").alias("src"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.col("_floor") + F.col("w")).alias("_given")), "calls")
        own = F.when(F.col("src") == F.col("dst"), F.lit(ENDLESS)).when(F.col("_given") > ENDLESS, F.lit(ENDLESS)).otherwise(F.col("_given"))
        given = moved.groupBy("program_id", F.col("dst").alias("id")).agg(F.max(own).alias("_given"))
        nodes = heads.join(given, ["program_id", "id"], "left").select("program_id", "id", F.greatest("floor", "_given").alias("floor"))
        edges = moved.where("src <> dst").groupBy("program_id", "src", "dst").agg(F.max("w").alias("w"))
        edges, nodes = stored_together((edges, "calls"), (nodes, "waiting"))
    else:
        raise RuntimeError("the call graph did not settle")
    depths = nodes.limit(0).select("program_id", "id", F.col("floor").alias("depth"))
    for part in known:
        depths = depths.unionByName(part)
    for hung in reversed(hanging):
        depths = stored(depths, "depths")
        above = depths.select("program_id", F.col("id").alias("p"), "depth")
        mine = hung.join(above, ["program_id", "p"], "left").select("program_id", "id", F.least(F.greatest("floor", F.col("depth") + F.col("w")), F.lit(ENDLESS)).alias("depth"))
        depths = depths.unionByName(mine)
    cyclic = F.col("depth") >= ENDLESS
    return depths.select("program_id", F.col("id").alias("func_id"), F.when(~cyclic, F.col("depth")).cast("int").alias("depth"), cyclic.alias("cyclic"))
