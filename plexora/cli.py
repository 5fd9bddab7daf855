"""``python -m plexora.cli guide-graph -i matrix.parquet -o out``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plexora")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("guide-graph", help="wide matrix to guide graph")
    g.add_argument("-i", "--input", required=True)
    g.add_argument("-o", "--output", required=True)
    g.add_argument("-t", "--threads", type=int, default=0, help="cores of a local session; 0 for a given cluster session")
    g.add_argument("--nfeat", type=int, default=5000)
    g.add_argument("--cv", type=float, default=0.1)
    g.add_argument("--chksim", action="store_true")
    g.add_argument("--pcc", type=float, default=0.95)
    g.add_argument("--mi", type=float, default=0.05)
    g.add_argument("--maxwin", type=float, default=0.98)
    g.add_argument("--minwin", type=float, default=0.33)
    g.add_argument("--stepwin", type=float, default=0.07)
    g.add_argument("--stepslide", type=float, default=0.07)
    return p


def main(argv: Sequence[str] | None = None) -> str:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from plexora.operators.reshape import to_long
    from plexora.plans.guide_graph import guide_graph
    from plexora.session import build_session
    from plexora.sources.graphs import write_guide_graph

    spark = build_session(str(a.threads)) if a.threads else SparkSession.builder.getOrCreate()
    g = guide_graph(to_long(spark.read.parquet(a.input)), a.nfeat, a.cv, a.chksim, a.pcc, a.mi, a.maxwin, a.minwin, a.stepwin, a.stepslide)
    path = write_guide_graph(g.edges, g.matrix, a.output, g.params, g.similar)
    print(path)
    return path


if __name__ == "__main__":
    main()
