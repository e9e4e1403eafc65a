"""Command line: python -m lodestone build | info | edit."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.builder import BuildOptions, LodModel
from lodestone.session import prepare
from lodestone.sources.binary_meshes import load_soup


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description="Level-of-detail models on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="a model file from mesh files or folders of them")
    build.add_argument("inputs", nargs="+")
    build.add_argument("-o", "--output", required=True)
    build.add_argument("-f", "--faces", type=int, default=BuildOptions().node_faces, help="faces of a node")
    build.add_argument("-t", "--top", type=int, default=BuildOptions().top_faces, help="faces of the top node")
    build.add_argument("-s", "--scaling", type=float, default=BuildOptions().scaling, help="share of faces that a level keeps")
    build.add_argument("-a", "--adaptive", type=float, default=BuildOptions().adaptive, help="band of a cell in which it may be split")
    build.add_argument("-z", "--compress", type=float, metavar="QUALITY", help="compress payloads at this share of the error")
    info = commands.add_parser("info", help="what a model file holds")
    info.add_argument("input")
    for name, what in (("nodes", "a row a node"), ("dag", "the children of each node"), ("patches", "a row a patch")):
        info.add_argument(f"--{name}", action="store_true", help=what)
    edit = commands.add_parser("edit", help="a selection of a model file, as a model or a mesh")
    edit.add_argument("input")
    edit.add_argument("-o", "--output", required=True, help="by its suffix: .ply and .stl are meshes, all others models")
    edit.add_argument("-s", "--size", type=int, help="bytes of the chosen nodes at most")
    edit.add_argument("-e", "--error", type=float, help="only nodes of at least this error")
    edit.add_argument("-t", "--triangles", type=int, help="triangles of the chosen nodes at most")
    edit.add_argument("-l", "--level", type=int, help="only the first levels")
    edit.add_argument("-d", "--drop-last", action="store_true", help="without the finest nodes")
    edit.add_argument("-z", "--compress", type=float, metavar="QUALITY", help="compress payloads at this share of the error")
    return top


def _print(df: DataFrame, order: str | None = None) -> None:
    print("\t".join(df.columns))
    for row in (df.orderBy(order) if order else df).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def info(model: LodModel, args: argparse.Namespace) -> None:
    from lodestone.operators import dag

    _print(model.info())
    if args.nodes:
        _print(model.nodes.select("node", "error", "radius", "nvert", "nface", "bytes"), "node")
        n = F.count("*") + 1  # the sink counts as a node without faces
        mean = F.sum("nface") / n
        _print(model.nodes.agg(mean.alias("mean_faces"), F.sqrt(F.sum(F.col("nface") * F.col("nface")) / n - mean * mean).alias("deviation")))
        _print(dag.last_level_bytes(model.nodes, model.patches))
    if args.dag:
        _print(dag.adjacency(model.patches), "node")
    if args.patches:
        _print(dag.patch_dump(model.patches), "patch")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = prepare(spark or SparkSession.builder.appName("lodestone").getOrCreate())
    if args.command == "build":
        options = BuildOptions(node_faces=args.faces, top_faces=args.top, scaling=args.scaling, adaptive=args.adaptive)
        LodModel.build(load_soup(spark, *args.inputs), options).save(args.output, quality=args.compress)
        return
    model = LodModel.open(spark, args.input)
    if args.command == "info":
        info(model, args)
        return
    chosen = model.select(size=args.size, error=args.error, triangles=args.triangles, level=args.level, drop_last=args.drop_last)
    suffix = args.output.rpartition(".")[2].lower()
    if suffix == "ply":
        model.save_ply(chosen, args.output)
    elif suffix == "stl":
        model.save_stl(chosen, args.output)
    else:
        model.save(args.output, chosen, quality=args.compress)


if __name__ == "__main__":
    main()
