"""Text forms of structural elements and stems, element graphs, scripts, and all pseudoknot orders."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.secondary import elements_of

#: What the text of an element begins with.
LABELS = {"stem": "Stem", "hairpin": "Hairpin", "loop": "Loop", "single": "SingleStrand", "5'": "SingleStrand5p", "3'": "SingleStrand3p"}
#: Most stems of a group of crossing ones whose orders are listed: 7 stems have 5,040 permutations.
MOST = 7


def element_text(kind: Column, strands: Column, sequence: Column, structure: Column) -> Column:
    """An element as its label, then first, last, sequence and brackets of each strand."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[kind]
    part = lambda s: F.concat_ws(" ", s["first"].cast("string"), s["last"].cast("string"), F.substr(sequence, s["first"], s["last"] - s["first"] + 1), F.substr(structure, s["first"], s["last"] - s["first"] + 1))
    return F.concat_ws(" ", label, F.array_join(F.transform(strands, part), " "))


def element_lines(elements: DataFrame, structures: DataFrame) -> DataFrame:
    """(id, kind, strands, text) of elements with (id, sequence, structure)."""
    joined = elements.join(structures.select("id", "sequence", "structure"), "id")
    return joined.select("id", "kind", "strands", element_text(F.col("kind"), F.col("strands"), F.col("sequence"), F.col("structure")).alias("text"))


def decompose(bpseq: DataFrame, ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of the structure without its pseudoknots, and the stems that are left out: (id, i, pair) with pairs of
    order above 0 unpaired, and the pairs of those orders. ``ordered``: id, i, j, order."""
    knots = ordered.where("`order` > 0")
    ends = knots.select("id", "i").unionByName(knots.select("id", F.col("j").alias("i"))).withColumn("_knot", F.lit(True))
    plain = bpseq.join(ends, ["id", "i"], "left").withColumn("pair", F.when(F.col("_knot"), 0).otherwise(F.col("pair")).cast("int"))
    from helixframe.operators.secondary import stems_of

    return elements_of(plain.select("id", "i", "pair")), stems_of(knots.select("id", "i", "j"))


def stem_rows(elements: DataFrame) -> DataFrame:
    """(id, stem, first_5p, last_5p, first_3p, last_3p, length): stems in order, for a CSV table."""
    from pyspark.sql import Window

    stems = elements.where("kind = 'stem'").select("id", F.col("strands")[0].alias("a"), F.col("strands")[1].alias("b"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("a.first")) - 1
    return stems.select("id", number.alias("stem"), F.col("a.first").alias("first_5p"), F.col("a.last").alias("last_5p"), F.col("b.first").alias("first_3p"), F.col("b.last").alias("last_3p"), (F.col("a.last") - F.col("a.first") + 1).alias("length"))


def element_graph(lines: DataFrame) -> DataFrame:
    """(id, content): a DOT graph per structure whose nodes are elements and whose edges join elements that share a
    boundary; stems of one pair are left out."""
    from pyspark.sql import Window

    shown = lines.where("not (kind = 'stem' and strands[0].first = strands[0].last)")
    stops = F.array_distinct(F.concat(F.transform("strands", lambda s: s["first"]), F.transform("strands", lambda s: s["last"])))
    kind = F.when(F.col("kind").isin("5'", "3'", "single"), 0).when(F.col("kind") == "stem", 1).when(F.col("kind") == "hairpin", 2).otherwise(3)
    numbered = shown.withColumn("e", F.row_number().over(Window.partitionBy("id").orderBy(kind, F.col("strands")[0]["first"])) - 1).withColumn("stop", F.explode(stops))
    ends = numbered.select("id", "e", "stop")
    edges = ends.join(ends.withColumnRenamed("e", "f"), ["id", "stop"]).where("e < f").select("id", "e", "f").distinct()
    nodes = numbered.select("id", "e", F.lit(-1).alias("f"), F.format_string('  E%d [label="%s"]', "e", "text").alias("line")).distinct()
    drawn = edges.select("id", "e", "f", F.format_string("  E%d -- E%d", "e", "f").alias("line"))
    rows = nodes.withColumn("k", F.lit(0)).unionByName(drawn.withColumn("k", F.lit(1)))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "e", "f", "line"))).alias("l"))
    return grouped.select("id", F.concat(F.lit("graph {\n"), F.array_join("l.line", "\n"), F.lit("\n}\n")).alias("content"))


def stem_script(stems: DataFrame) -> DataFrame:
    """(id, content): a PyMOL script that draws each stem as cylinders between the centroids of its pairs.

    ``stems``: id, stem, chain_5p, first_5p, last_5p, chain_3p, first_3p, last_3p (the residues' own numbers), centroids
    (points in order).
    """
    xyz = lambda p: F.format_string("%.3f, %.3f, %.3f", p[0], p[1], p[2])
    stem, c = F.col("stem"), F.col("centroids")
    select = F.format_string("select stem%d, %s/%d-%d/ or %s/%d-%d/", "stem", "chain_5p", "first_5p", "last_5p", "chain_3p", "first_3p", "last_3p")
    drawn = F.size(c) > 1
    atoms = F.transform(c, lambda p, i: F.concat(F.format_string("pseudoatom stem%d_centroid%d, pos=[", stem, i), xyz(p), F.lit("]")))
    tubes = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda p, i: F.concat(F.lit("cmd.load_cgo([ 9.0, "), xyz(F.get(c, i)), F.lit(", "), xyz(p), F.format_string(', 0.5, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0 ], "stem_%d_seg_%d")', stem, i)))
    turns = F.transform(F.slice(c, 4, F.greatest(F.size(c) - 3, F.lit(0))), lambda p, i: F.format_string("dihedral stem%d_dihedral%d, stem%d_centroid%d, stem%d_centroid%d, stem%d_centroid%d, stem%d_centroid%d", stem, i, stem, i, stem, i + 1, stem, i + 2, stem, i + 3))
    lines = F.concat(F.array(select), F.when(drawn, F.concat(atoms, tubes, turns)).otherwise(F.array().cast("array<string>")))
    grouped = stems.select("id", "stem", F.array_join(lines, "\n").alias("text")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("stem", "text"))).alias("t"))
    return grouped.select("id", F.array_join("t.text", "\n").alias("content"))


def all_orders(stems: list[tuple[int, int, int]], most: int = MOST) -> list[list[int]]:
    """All assignments of orders to stems (first i, last j, length) that come from taking the stems of each group of
    crossing ones in some sequence, each with the lowest order free. Raises ValueError for a group of over ``most``."""
    n = len(stems)
    crosses = [{b for b in range(n) if stems[a][0] < stems[b][0] < stems[a][1] < stems[b][1] or stems[b][0] < stems[a][0] < stems[b][1] < stems[a][1]} for a in range(n)]
    seen: set[int] = set()
    choices = []
    for start in range(n):
        if start in seen or not crosses[start]:
            continue
        group, todo = {start}, [start]
        while todo:
            for x in crosses[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        seen |= group
        if len(group) > most:
            raise ValueError(f"{len(group)} crossing stems have too many sequences; the limit is {most}")
        found = set()
        for sequence in itertools.permutations(sorted(group)):
            order: dict[int, int] = {}
            for s in sequence:
                taken = {order[x] for x in crosses[s] if x in order}
                order[s] = next(k for k in itertools.count() if k not in taken)
            found.add(tuple(sorted(order.items())))
        choices.append(sorted(found))
    out = {tuple(dict(itertools.chain.from_iterable(pick)).get(s, 0) for s in range(n)) for pick in itertools.product(*choices)}
    return [list(x) for x in sorted(out)]


def all_orders_of(stems: DataFrame, most: int = MOST) -> DataFrame:
    """(id, solution, i, j, length, order): all assignments for each structure's stems (id, i, j, length)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        rows = list(zip(pdf["i"], pdf["j"], pdf["length"]))
        parts = [pdf.assign(solution=k, order=orders) for k, orders in enumerate(all_orders(rows, most))]
        return pd.concat(parts)[["id", "solution", "i", "j", "length", "order"]]

    kinds = dict(stems.dtypes)
    return stems.select("id", "i", "j", "length").groupBy("id").applyInPandas(run, f"id {kinds['id']}, solution int, i {kinds['i']}, j {kinds['j']}, length {kinds['length']}, order int")


def strand_residues(strands: DataFrame, placed: DataFrame) -> DataFrame:
    """Residues of strands (id, first, last): rows of ``placed`` (id, place) whose place lies in the strand."""
    places = strands.withColumn("place", F.explode(F.sequence("first", "last")))
    return places.join(placed, ["id", "place"])
