"""What a module exports under a name, through chains of re-exports.

A node is a (file, name). Its own top-level definition ends the search; otherwise
the re-exports of the file that match the name are tried in order, depth first,
and a node met before on the way gives nothing.

Chains without a choice are not walked. Files whose only re-export passes
everything on form paths: a path is numbered by pointer doubling, and the first
definition of a name at or after a place of the path is found by one ordered scan
over path and name. Renamed exports without an alternative are doubled as nodes.
What remains, one row per node, is a graph of choices; its nodes are settled
backwards from the definitions as soon as the first re-export that can still
succeed has. Only nodes whose first choices lead round a cycle depend on where a
search began; they are searched from each wanted node, inside what is unsettled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from patchlore.plans.pointers import ends
from patchlore.plans.scan import by_width, last_value, scan
from patchlore.plans.skew import all_of, skew_join
from patchlore.session import cut

NODE = ["file", "name"]
PATH_BLOCK = 1 << 16


def _paths(hops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file, path, dist, exit) of the files whose only re-export is ``*``.

    Of the files that pass on to one file, the smallest is on its path; the path of
    the others ends with them. A path round a cycle is cut before its smallest file.
    """
    stars = F.count_if(F.col("exported") == "*")
    single = hops.groupBy(*keys, "file").agg(F.count("*").alias("_n"), stars.alias("_s"), F.min("to").alias("to")).filter("_n = 1 AND _s = 1")
    single = cut(single.select(*keys, "file", "to"), "single")
    main = single.groupBy(*keys, "to").agg(F.min("file").alias("file"))
    main = main.join(single.select(*keys, F.col("file").alias("to")), keys + ["to"], "left_semi")
    step = single.select(*keys, "file").join(main.select(*keys, "file", F.col("to").alias("next")), keys + ["file"], "left")
    ranked = ends(step, keys, ["file"], ["next"])
    if not ranked.filter("live").isEmpty():
        loop = ranked.filter("live").select(*keys, "file", F.col("low.file").alias("_low"))
        opened = loop.join(main.select(*keys, "file", F.col("to").alias("next")), keys + ["file"])
        opened = opened.withColumn("next", F.when(F.col("next") != F.col("_low"), F.col("next"))).select(*keys, "file", "next")
        ranked = ranked.filter("NOT live").unionByName(ends(opened, keys, ["file"], ["next"]))
    exits = single.select(*keys, F.col("file").alias("path"), F.col("to").alias("exit"))
    return cut(ranked.select(*keys, "file", F.col("end_file").alias("path"), "dist").join(exits, keys + ["path"]), "paths")


def _unary(hops: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file, name, end_file, end_name): where renamed exports without an alternative lead; null round a cycle."""
    starred = hops.filter(F.col("exported") == "*").select(*keys, "file").distinct()
    named = hops.filter(F.col("exported") != "*").join(starred, keys + ["file"], "left_anti")
    one = named.groupBy(*keys, "file", F.col("exported").alias("name")).agg(
        F.count("*").alias("_n"), F.min("to").alias("to"), F.min("imported").alias("as")).filter("_n = 1").drop("_n")
    at = ends(one.join(own, keys + NODE, "left_anti"), keys, NODE, ["to", "as"])
    return at.select(*keys, *NODE, *[F.when(~F.col("live"), F.col(f"end_{c}")).alias(f"end_{c}") for c in NODE])


def _jump(rows: DataFrame, unary: DataFrame, keys: list[str], file: str, name: str) -> DataFrame:
    """Move the node in (file, name) to the end of its renamed exports; nodes that go round a cycle are dropped."""
    there = unary.select(*keys, F.col("file").alias(file), F.col("name").alias(name), "end_file", "end_name", F.lit(True).alias("_u"))
    d = skew_join(rows, there, keys + [file, name], "left").filter("_u IS NULL OR end_file IS NOT NULL")
    moved = d.withColumn(file, F.coalesce("end_file", file)).withColumn(name, F.coalesce("end_name", name))
    return moved.select(*rows.columns)


def _along_paths(nodes: DataFrame, paths: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file, name, def_id, exit) of nodes on paths: the first definition at or after them, null if there is none."""
    asked = skew_join(nodes, paths, keys + ["file"]).select(*keys, "path", "name", "dist", F.lit(1).alias("_ask"), "file", "exit")
    there = own.join(paths, keys + ["file"]).select(*keys, "path", "name", "dist", F.lit(0).alias("_ask"), "def_id")
    both = there.unionByName(asked, allowMissingColumns=True).withColumnRenamed("def_id", "_def")
    found = scan(both, keys + ["path", "name"], ["dist", "_ask"], {"def_id": last_value(F.col("_def"))}, by_width("dist", PATH_BLOCK))
    return found.filter("_ask = 1").select(*keys, *NODE, "def_id", "exit")


def _explore(starts: DataFrame, hops: DataFrame, own: DataFrame, paths: DataFrame, unary: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with a definition (keys, file, name, def_id), and the choices of all others (keys, file, name, pos, to, as)."""
    star, named = hops.filter(F.col("exported") == "*"), hops.filter(F.col("exported") != "*")
    front = cut(starts, "front")
    seen, settled, choices = front, None, None
    rounds = 0
    while True:
        hit = front.join(own, keys + NODE)
        open_ = skew_join(front, own.select(*keys, *NODE), keys + NODE, "left_anti")
        passed = cut(_along_paths(open_, paths, own, keys), "passed")
        free = skew_join(open_, paths.select(*keys, "file"), keys + ["file"], "left_anti")
        by_star = skew_join(free, star.select(*keys, "file", "pos", "to"), keys + ["file"]).select(*keys, *NODE, "pos", "to", F.col("name").alias("as"))
        by_name = skew_join(free, named.select(*keys, "file", F.col("exported").alias("name"), "pos", "to", F.col("imported").alias("as")), keys + NODE)
        onward = passed.filter("def_id IS NULL").select(*keys, *NODE, F.lit(0).cast("long").alias("pos"), F.col("exit").alias("to"), F.col("name").alias("as"))
        all_ = by_star.unionByName(by_name.select(*keys, *NODE, "pos", "to", "as")).unionByName(onward)
        made = cut(_jump(all_, unary, keys, "to", "as"), "choices")
        done = hit.select(*keys, *NODE, "def_id").unionByName(passed.filter("def_id IS NOT NULL").select(*keys, *NODE, "def_id"))
        settled = done if settled is None else settled.unionByName(done)
        choices = made if choices is None else choices.unionByName(made)
        front = made.select(*keys, F.col("to").alias("file"), F.col("as").alias("name")).distinct()
        front = cut(front.join(seen, keys + NODE, "left_anti"), "front")
        if front.isEmpty():
            return cut(settled, "settled"), choices
        seen = seen.unionByName(front)
        rounds += 1
        if rounds % 8 == 0:  # keep the plans short where choices are nested deeply
            seen, settled, choices = cut(seen, "seen"), cut(settled, "settled"), cut(choices, "choices")


def _settle(settled: DataFrame, choices: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Settle nodes whose first choice that does not fail has succeeded; returns the settled nodes and the choices of the rest."""
    rounds = 0
    left = choices.filter((F.col("file") != F.col("to")) | (F.col("name") != F.col("as"))).select(*keys, *NODE, "pos", "to", "as")
    size = -1
    while True:
        alive = left.select(*keys, *NODE).distinct().select(*keys, F.col("file").alias("to"), F.col("name").alias("as"), F.lit(True).alias("_open"))
        known = settled.select(*keys, F.col("file").alias("to"), F.col("name").alias("as"), F.col("def_id").alias("_def"))
        told = skew_join(skew_join(left, known, keys + ["to", "as"], "left"), alive, keys + ["to", "as"], "left")
        told = told.filter("_def IS NOT NULL OR _open")  # neither defined nor with choices left: it gives nothing
        best = told.groupBy(*keys, *NODE).agg(F.min(F.struct("pos", "to", "as", F.col("_def").alias("def_id"))).alias("_b"))
        step = cut(told.select(*left.columns).join(best.select(*keys, *NODE, F.col("_b.def_id").alias("_def")), keys + NODE), "step")
        found, rest = step.agg(F.count_if(F.col("_def").isNotNull()), F.count_if(F.col("_def").isNull())).first()
        left = step.filter("_def IS NULL").drop("_def")
        if found:
            settled = settled.unionByName(step.filter("_def IS NOT NULL").select(*keys, *NODE, F.col("_def").alias("def_id")).distinct())
        if not rest or (not found and rest == size):
            return settled, left
        size = rest
        rounds += 1
        if rounds % 8 == 0:
            settled = cut(settled, "settled")


def _search(starts: DataFrame, settled: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file, name, def_id) found from each start by its own depth-first search.

    A way is kept as the array of its positions: comparing arrays is the
    depth-first order, and going round a cycle only makes an array longer, hence
    greater than the one that met the node first, so it is dropped.
    """
    spot = keys + ["o_file", "o_name", *NODE]
    front = starts.select(*keys, F.col("file").alias("o_file"), F.col("name").alias("o_name"), *NODE, F.array().cast("array<long>").alias("way"))
    front = cut(front, "ways")
    seen, rounds = front, 0
    while True:
        onward = skew_join(front, choices, keys + NODE).select(
            *keys, "o_file", "o_name", F.col("to").alias("file"), F.col("as").alias("name"), F.concat("way", F.array(F.col("pos").cast("long"))).alias("way"))
        onward = onward.groupBy(*spot).agg(F.min("way").alias("way"))
        better = all_of([F.col(f"n.{c}") == F.col(f"s.{c}") for c in spot] + [F.col("s.way") <= F.col("n.way")])
        front = cut(onward.alias("n").join(seen.alias("s"), better, "left_anti"), "ways")
        if front.isEmpty():
            hits = skew_join(seen, settled, keys + NODE)
            return hits.groupBy(*keys, "o_file", "o_name").agg(F.min_by("def_id", "way").alias("def_id")).withColumnsRenamed({"o_file": "file", "o_name": "name"})
        seen = seen.unionByName(front)
        rounds += 1
        if rounds % 16 == 0:
            seen = cut(seen, "seen")


def resolve_export(wanted: DataFrame, top_defs: DataFrame, reexports: DataFrame, keys: Sequence[str] = ("pr_id",)) -> DataFrame:
    """(keys, module, name, def_id) for every wanted (module, name) that some chain reaches.

    ``top_defs`` holds the first top-level def per (file, name). ``reexports``
    holds (file, pos, exported, imported, module), exported ``*`` passing every
    name on; a null ``imported`` stands for the exported name.
    """
    keys = list(keys)
    own = cut(top_defs.select(*keys, *NODE, "def_id"), "own")
    name_type = own.schema["name"].dataType
    hops = cut(reexports.select(*keys, "file", F.col("pos").cast("long").alias("pos"), F.col("exported").cast("string").alias("exported"),
                                F.col("module").alias("to"), "imported"), "hops")
    plain = F.when(F.col("exported") != "*", F.coalesce(F.col("imported").cast(name_type), F.col("exported").try_cast(name_type)))
    hops = hops.withColumn("imported", plain)
    unary = _unary(hops, own, keys).withColumn("name", F.col("name").try_cast(name_type))
    paths = _paths(hops, keys)
    asked = wanted.select(*keys, "module", "name").distinct().withColumns({"file": F.col("module"), "as": F.col("name")})
    asked = cut(_jump(asked, unary, keys, "file", "as"), "asked")
    starts = asked.select(*keys, "file", F.col("as").alias("name")).distinct()
    settled, choices = _settle(*_explore(starts, hops, own, paths, unary, keys), keys)
    if not choices.isEmpty():
        settled = cut(settled, "settled")
        circling = starts.join(choices.select(*keys, *NODE).distinct(), keys + NODE, "left_semi")
        settled = settled.unionByName(_search(circling, settled, choices, keys))
    found = settled.select(*keys, "file", F.col("name").alias("as"), "def_id")
    return asked.join(found, keys + ["file", "as"]).select(*keys, "module", "name", "def_id")
