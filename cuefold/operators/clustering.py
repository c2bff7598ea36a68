"""Near-duplicate titles: a similarity self-join and greedy leader clusters in score order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.pandas.types import to_arrow_schema

from cuefold.functions import text as T
from cuefold.operators import near_titles
from cuefold.operators.ranks import drop_staged, numbered, numbered_within, same, staged

#: Signs of the titles of one tile: tiles are compared in twos. Up to TILES of a group and band are made, then the tiles grow, to LARGE times that.
TILE, TILES, LARGE = 320_000, 24, 6
#: The first nodes of a group whose leaders are found before the others are compared with these, and by how much more it is each time.
FIRST, MORE = 3_000, 12
#: Open edges of a group that are settled as one sorted stream; larger groups go by rounds first.
STREAM = 1_000_000


def _sorted_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def _spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of few bytes and much work: dealt out over several tasks a core, however small they are."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def _prefixes(keys: DataFrame, jaccard: float, within: list[str]) -> DataFrame:
    """`keys` (within..., key, ...) with n, set, at and t: once for each token of their prefix.

    With tokens ordered by how rare they are, two sets that reach the threshold meet in the first n - ceil(t * n) + 1 of both.
    """
    own = [c for c in keys.columns if c not in within]
    words = keys.where("key <> ''").select(*within, *own, F.explode(F.split("key", " ")).alias("t"))
    rank = words.groupBy(*within, "t").agg(F.count("*").alias("df"))
    met = words.alias("l").join(rank.alias("r"), (F.col("l.t") == F.col("r.t")) & same("l", "r", within)).select("l.*", "r.df")
    ordered = met.groupBy(*within, *own).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    n = F.size("o")
    length = (n - F.ceil(n * jaccard - 1e-9) + 1).cast("int")
    prefix = ordered.select(*within, *own, n.alias("n"), F.transform("o", lambda x: x["t"]).alias("set"), F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "p"))
    return prefix.select(*within, *own, "n", "set", "at", F.col("p.t").alias("t"))


def _met(left: DataFrame, right: DataFrame, jaccard: float, within: list[str], order: Column) -> DataFrame:
    """The pairs l, r of rows of `_prefixes` whose sets reach the threshold and that `order` lets.

    Of the tokens that a pair has in common it is found by the first alone, which is in both prefixes if any is: each pair comes out once.
    """
    sizes = (F.col("l.n") * jaccard <= F.col("r.n")) & (F.col("r.n") * jaccard <= F.col("l.n"))
    # the tokens from the common one on have to be enough for the threshold
    enough = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) >= (F.col("l.n") + F.col("r.n")) * (jaccard / (1 + jaccard)) - 1e-6
    first = (F.col("l.at") == 0) | (F.col("r.at") == 0) | ~F.arrays_overlap(F.slice("l.set", F.lit(1), F.col("l.at")), F.slice("r.set", F.lit(1), F.col("r.at")))
    met = _spread(left, *within, "t").alias("l").join(_spread(right, *within, "t").alias("r"), same("l", "r", within) & (F.col("l.t") == F.col("r.t")) & order & sizes & enough)
    share = lambda common: common / (F.col("l.n") + F.col("r.n") - common) >= jaccard
    return met.where(first & T.let(F.size(F.array_intersect("l.set", "r.set")), share))


def _jaccard_pairs(keys: DataFrame, jaccard: float, within: list[str]) -> DataFrame:
    prefix = _prefixes(keys, jaccard, within)
    pairs = _met(prefix, prefix, jaccard, within, F.col("l.key") < F.col("r.key"))
    return pairs.select(*[F.col(f"l.{c}").alias(c) for c in within], F.col("l.key").alias("a"), F.col("r.key").alias("b"), F.lit(True).alias("ab"), F.lit(True).alias("ba"))


def _banded(keys: DataFrame, ratio: float) -> DataFrame:
    """`keys` with n and band. Lengths of an alike pair differ by less than the factor 2 / ratio - 1, so bands of that factor meet in the same or the next one."""
    sized = keys.withColumn("n", F.length("key")).where("n > 0")
    return sized.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(2 / ratio - 1))).cast("int"))


def _dealt(sized: DataFrame, within: list[str], tile: int) -> DataFrame:
    """(within..., band, tiles): how many tiles a band of a group is dealt out over. Small groups have tiles of about `tile` signs, larger ones fewer than that, as each tile goes to as many tasks as there are."""
    wanted = F.sum("n") / tile
    tiles = F.greatest(F.least(F.ceil(wanted), F.lit(TILES)), F.ceil(wanted / LARGE))
    return staged(sized.groupBy(*within, "band").agg(tiles.cast("int").alias("tiles")), "tiles")


def _near_tiles(sized: DataFrame, tiles: DataFrame, within: list[str]) -> DataFrame:
    """`sized` with the tiles of its own band, the one above and the one below."""
    for k, step in (("own", 0), ("above", 1), ("below", -1)):
        found = sized.alias("l").join(tiles.withColumn("band", F.col("band") - step).alias("r"), same("l", "r", [*within, "band"]), "left")
        sized = found.select("l.*", F.coalesce("r.tiles", F.lit(0)).alias(k))
    return sized


def _place(band: Column, i: Column, next_: Column, j: Column, left: Column, right: Column) -> Column:
    return F.struct(band.alias("band"), i.alias("i"), next_.alias("next"), j.alias("j"), left.alias("left"), right.alias("right"))


def _each(n: Column, made: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: j < n), made)


def _placed(sized: DataFrame, places: list[Column], within: list[str], kept: list[str]) -> DataFrame:
    return sized.select(*within, *kept, F.explode(F.concat(*places)).alias("p")).select(*within, *kept, "p.*")


def _tiles(keys: DataFrame, ratio: float, within: list[str], tile: int) -> DataFrame:
    """(within..., what `keys` has, band, i, next, j, left, right): each key once for each two tiles of its group that it is compared in."""
    kept, sized = [c for c in keys.columns if c not in within], _banded(keys, ratio)
    sized = _near_tiles(sized, _dealt(sized, within, tile), within)
    band, at, yes, no = F.col("band"), F.pmod(F.xxhash64("key"), F.col("own")).cast("int"), F.lit(True), F.lit(False)
    own = _each(F.col("own"), lambda j: _place(band, F.least(at, j), band, F.greatest(at, j), at <= j, at >= j))
    above = _each(F.col("above"), lambda j: _place(band, at, band + 1, j, yes, no))
    below = _each(F.col("below"), lambda j: _place(band - 1, j, band, at, no, yes))
    return _placed(sized, [own, above, below], within, kept)


def _crossed_tiles(leaders: DataFrame, rest: DataFrame, ratio: float, within: list[str], tile: int) -> DataFrame:
    """The same of each two tiles of which one is of `leaders`, the left one, and one of `rest`."""
    kept, out = [c for c in rest.columns if c not in within], []
    sides = [_banded(x, ratio) for x in (leaders, rest)]
    tiles = [_dealt(x, within, tile) for x in sides]
    band, yes, no = F.col("band"), F.lit(True), F.lit(False)
    for k, (own, other) in enumerate((tiles, tiles[::-1])):
        dealt = sides[k].alias("l").join(own.alias("r"), same("l", "r", [*within, "band"])).select("l.*", F.pmod(F.xxhash64("l.key"), F.col("r.tiles")).cast("int").alias("i"))
        at = F.col("i")
        place = (lambda step, at=at: lambda j: _place(band, at, band + step, j, yes, no)) if k == 0 else (lambda step, at=at: lambda j: _place(band + step, j, band, at, no, yes))
        places = [_each(F.col(name), place(step)) for name, step in (("own", 0), ("above", 1), ("below", -1))]
        out.append(_placed(_near_tiles(dealt, other, within), places, within, kept))
    return out[0].unionByName(out[1])


def _by_tiles(placed: DataFrame, found: str, run: Callable[[pa.Table, pa.Table | None], dict[str, list]], within: list[str], crossed: bool = False) -> DataFrame:
    """(within..., what `found` names): what `run` finds in the rows of each two tiles, the right ones None where one tile meets itself."""
    schema = Y.StructType([*[placed.schema[c] for c in within], *Y._parse_datatype_string(found)])
    arrow = to_arrow_schema(schema)

    def compare(group: tuple, rows: pa.Table) -> pa.Table:
        one = not crossed and group[-4] == group[-2] and group[-3] == group[-1]
        left, right = rows.filter(rows["left"]), None if one else rows.filter(rows["right"])
        values = run(left, right) if left.num_rows and (one or right.num_rows) else {}
        n = len(next(iter(values.values()), []))
        return pa.Table.from_arrays([pa.repeat(x, n) for x in group[: len(within)]] + [pa.array(values.get(f.name, []), f.type) for f in list(arrow)[len(within) :]], schema=arrow)

    place = [*within, "band", "i", "next", "j"]
    return _spread(placed, *place).groupBy(*place).applyInArrow(compare, schema)


def _ratio_pairs(keys: DataFrame, ratio: float, within: list[str], tile: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table | None) -> dict[str, list]:
        found = near_titles.alike(left["key"].to_pylist(), right and right["key"].to_pylist(), ratio)
        return {c: [x[k] for x in found] for k, c in enumerate(("a", "b", "ab", "ba"))}

    return _by_tiles(_tiles(keys.select(*within, "key"), ratio, within, tile), "a string, b string, ab boolean, ba boolean", run, within)


def _numbers(rows: pa.Table) -> list[tuple[int, str]]:
    return list(zip(rows["number"].to_pylist(), rows["key"].to_pylist(), strict=True))


def _edges(nodes: DataFrame, prefix: DataFrame, jaccard: float, ratio: float | None, within: list[str], tile: int) -> DataFrame:
    """(within..., early, late): the numbers of the nodes of which the later one is like the earlier one."""

    def run(left: pa.Table, right: pa.Table | None) -> dict[str, list]:
        found = list(near_titles.followed(_numbers(left), right and _numbers(right), ratio))
        return {"early": [x for x, _ in found], "late": [x for _, x in found]}

    met = _met(prefix, prefix, jaccard, within, F.col("l.number") < F.col("r.number"))
    out = met.select(*[F.col(f"l.{c}").alias(c) for c in within], F.col("l.number").alias("early"), F.col("r.number").alias("late"))
    if ratio is None:
        return out
    return out.unionByName(_by_tiles(_tiles(nodes, ratio, within, tile), "early int, late int", run, within)).distinct()


def _first_leaders(leaders: DataFrame, rest: DataFrame, prefixes: list[DataFrame], jaccard: float, ratio: float | None, within: list[str], tile: int) -> DataFrame:
    """(within..., late, early): the nodes of `rest` that are like a leader, all of which come before them, with the first such one."""

    def run(left: pa.Table, right: pa.Table) -> dict[str, list]:
        found = near_titles.first_leaders(_numbers(left), _numbers(right), ratio)
        return {"early": list(found.values()), "late": list(found)}

    met = _met(*prefixes, jaccard, within, F.lit(True))
    out = met.select(*[F.col(f"l.{c}").alias(c) for c in within], F.col("l.number").alias("early"), F.col("r.number").alias("late"))
    if ratio is not None:
        out = out.unionByName(_by_tiles(_crossed_tiles(leaders, rest, ratio, within, tile), "early int, late int", run, within, crossed=True))
    return out.groupBy(*within, "late").agg(F.min("early").alias("early"))


def similar_titles(rows: DataFrame, stop_words: list[str], jaccard: float = 0.65, sequence: float | None = 0.78, within: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(within..., a, b, ab, ba): pairs of distinct title keys, a < b, alike by token Jaccard or by the sequence ratio of their sorted tokens; `rows` has title and the columns `within`.

    The ratio depends on the order of its two sides: `ab` and `ba` tell which order reaches the threshold. Titles with the same sorted
    tokens are one key, so copies of a title are no pairs here: they are alike, whatever the thresholds. `sequence` None leaves the ratio out.

    Jaccard pairs meet by a prefix filter. For the ratio a filter on rare letters or letter pairs does not pay: a ratio of 0.78 needs 39 per
    cent of both texts' letters only, so prefixes are long and met in 1,140,397 rows where all pairs of fitting lengths are 304,629 (871
    titles, letters numbered; 1,405,529 with letter pairs). So the titles of a group of `within` are compared by tiles of fitting lengths,
    two tiles a task: of those pairs 18,373 pass the bound of common letters, 370 that of the longest common subsequence, and 370 are compared. No pair leaves
    its tiles that is not alike. The work still grows with the square of the titles of a group, and so do the pairs: meant for the titles of a day.
    """
    within = within or []
    keys = rows.select(*within, _sorted_key(T.event_tokens(F.col("title"), stop_words)).alias("key")).distinct()
    return _similar_keys(keys, jaccard, sequence, within, tile)


def _similar_keys(keys: DataFrame, jaccard: float, sequence: float | None, within: list[str], tile: int = TILE) -> DataFrame:
    out = _jaccard_pairs(keys, jaccard, within)
    if sequence is None:
        return out
    return out.unionByName(_ratio_pairs(keys, sequence, within, tile)).groupBy(*within, "a", "b").agg(F.bool_or("ab").alias("ab"), F.bool_or("ba").alias("ba"))


def _settled(edges: DataFrame, within: list[str]) -> DataFrame:
    """(within..., number) of the followers of whole groups of edges, each group one stream in order of the later node; what is kept is the group's followers so far."""
    schema = Y.StructType([*[edges.schema[c] for c in within], Y.StructField("number", Y.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, follows, late, led = None, set(), None, False
        for batch in batches:
            found = []
            for *key, early, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, node) != (group, late):
                    if led:
                        follows.add(late)
                        found.append((*group, late))
                    if key != group:
                        follows = set()
                    group, late, led = key, node, False
                led = led or early not in follows
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], to_arrow_schema(schema))
        if led:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*group, late), strict=True))], to_arrow_schema(schema))

    dealt = (edges.repartition(*within) if within else edges.coalesce(1)).sortWithinPartitions(*within, "late")
    return dealt.select(*within, "early", "late").mapInArrow(run, schema)


def _matched(rows: DataFrame, side: str, found: DataFrame, within: list[str], how: str) -> DataFrame:
    return rows.alias("l").join(found.alias("r"), same("l", "r", within) & (F.col(f"l.{side}") == F.col("r.number")), how)


def _followers(edges: DataFrame, within: list[str], rounds: int, stream: int) -> list[DataFrame]:
    """Staged tables (within..., number) of the nodes that join an earlier leader. A leader is a node none of whose earlier neighbours is one.

    Groups of up to `stream` edges are settled by one pass each. In larger ones each round settles the nodes next to the leaders known so
    far and carries on with the open edges alone, until they are few enough; after `rounds` what is still open, chains longer than that, is settled by one pass.
    """
    named = lambda df, c: df.select(*within, F.col(c).alias("number"))
    out, old = [], []
    for left in range(rounds, -1, -1):
        large = staged(edges.groupBy(*within).count().where(F.col("count") > stream), "large_groups") if left else None
        is_large = large is not None and large.limit(1).count() > 0
        small = edges if not is_large else edges.alias("l").join(large.alias("r"), same("l", "r", within), "left_anti")
        out.append(staged(_settled(small, within), "followers"))
        if large is not None:
            old.append(large)
        if not is_large:
            break
        edges = staged(edges.alias("l").join(large.alias("r"), same("l", "r", within), "left_semi"), "edges")
        leads = _matched(named(edges, "early").distinct(), "number", named(edges, "late").distinct(), within, "left_anti")
        follow = staged(named(_matched(edges, "early", leads, within, "left_semi"), "late").distinct(), "followers")
        out.append(follow)
        rest = _matched(_matched(edges, "late", follow, within, "left_anti"), "early", follow, within, "left_anti")
        old.append(edges)
        edges = staged(rest, "edges")
        old.append(edges)
    drop_staged(*old)
    return out


def _led(nodes: DataFrame, jaccard: float, ratio: float | None, within: list[str], rounds: int, stream: int, tile: int, first: int) -> list[DataFrame]:
    """Staged tables (within..., late, early): the numbers of the followers among `nodes` (within..., key, number from 1 in their order) with that of their leader, the first one that they are like.

    The leaders among the first nodes of a group come from the edges between these alone; the nodes behind are compared with them, and those that are like one are done with.
    Then the next of those left follow. So the many titles of a common kind meet its leader and not each other, and edges are made between what no earlier leader has taken.
    """
    prefix = staged(_prefixes(nodes, jaccard, within), "prefixes")
    out, old, open_, words, last = [], [prefix], nodes, prefix, first
    while True:
        more = open_.where(F.col("number") > last).limit(1).count() > 0
        head, begin = (x.where(F.col("number") <= last) if more else x for x in (open_, words))
        edges = staged(_edges(head, begin, jaccard, ratio, within, tile), "edges")
        follows = _followers(edges, within, rounds, stream)
        follow = reduce(DataFrame.unionByName, follows)
        found = _matched(edges, "early", follow, within, "left_anti")  # a node next to an earlier leader follows
        out.append(staged(found.groupBy(*within, "late").agg(F.min("early").alias("early")), "led"))
        old += [edges, *follows]
        if not more:
            break
        rest, behind = (x.where(F.col("number") > last) for x in (open_, words))
        lead, begin = (_matched(x, "number", follow, within, "left_anti") for x in (head, begin))
        lead, rest = staged(lead, "leaders"), staged(rest, "rest")
        taken = staged(_first_leaders(lead, rest, [begin, behind], jaccard, ratio, within, tile), "led")
        done = taken.select(*within, F.col("late").alias("number"))
        out.append(taken)
        open_, words = staged(_matched(rest, "number", done, within, "left_anti"), "nodes"), staged(_matched(behind, "number", done, within, "left_anti"), "prefixes")
        old += [lead, rest, open_, words]
        last *= MORE
    drop_staged(*old)
    return out


def leader_clusters(
    rows: DataFrame, stop_words: list[str], jaccard: float = 0.65, sequence: float | None = 0.78, within: list[str] | None = None, penalty: float = 3.0,
    rounds: int = 20, stream: int = STREAM, tile: int = TILE, first: int = FIRST,
) -> DataFrame:
    """`rows` (video_id, title, final_score, ...) with event_key, semantic_duplicate_group, event_duplicate_penalty and the lowered final_score.

    In order of score (then id) each row joins the first leader that it is like, or becomes a leader. Rows of one key are one node of the
    similarity graph, placed by its best row; leaders are the nodes none of whose earlier neighbours is a leader. A group's rows lose
    `penalty` for each row of it before them. What is staged on the way is dropped but for the rows with their keys and each key's group.

    The first `first` nodes of a group find their leaders first, see `_led`. What still grows with the square of a group's titles is the
    comparison of those that no leader has taken.
    """
    within = within or []
    key = [*within, "event_key"]
    keyed = staged(rows.withColumn("event_key", _sorted_key(T.event_tokens(F.col("title"), stop_words))), "keyed")
    places = staged(keyed.groupBy(*key).agg(F.min(F.struct((-F.col("final_score")).alias("s"), F.col("video_id").alias("v"))).alias("place")), "places")
    order = ["place", "event_key"]
    nodes = numbered_within(places, "number", within, order) if within else numbered(places, "number", order)
    nodes = staged(nodes.select(*within, F.col("event_key").alias("key"), F.col("number").cast("int")), "nodes")
    found = _led(nodes, jaccard, sequence, within, rounds, stream, tile, first)
    led = nodes.alias("l").join(reduce(DataFrame.unionByName, found).alias("r"), same("l", "r", within) & (F.col("l.number") == F.col("r.late")), "left")
    member = staged(led.select("l.*", F.col("r.early").alias("leader")), "led")
    own = member.where("leader IS NULL").select(*within, "number")
    n = F.col("n").cast("string")
    placed = numbered_within(own, "n", within, ["number"]) if within else numbered(own, "n", ["number"])
    names = placed.select(*within, "number", F.concat(F.lit("event_"), F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))).alias("name"))
    named = _matched(member.withColumn("number", F.coalesce("leader", "number")), "number", names, within, "inner")
    groups = staged(named.select(*[F.col(f"l.{c}") for c in within], F.col("l.key").alias("event_key"), F.col("r.name").alias("semantic_duplicate_group")), "members")
    drop_staged(places, nodes, member, *found)
    named = keyed.alias("l").join(groups.alias("r"), same("l", "r", key)).select("l.*", "r.semantic_duplicate_group")
    ranked = numbered_within(named, "_rank", [*within, "semantic_duplicate_group"], [F.desc("final_score"), "video_id"])
    out = ranked.withColumn("event_duplicate_penalty", (F.col("_rank") - 1) * float(penalty)).drop("_rank")
    return out.withColumn("final_score", F.round(F.greatest(F.lit(0.0), F.col("final_score") - F.col("event_duplicate_penalty")), 3))
