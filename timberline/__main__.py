"""python -m timberline train|predict|info: training from delimited text or Parquet, scoring, and model facts."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, header: bool) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.csv(path, header=header, inferSchema=True)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> dict:
    from .operators.boost import Params, train
    from .sources import io

    parser = argparse.ArgumentParser(prog="timberline")
    sub = parser.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train")
    t.add_argument("data"), t.add_argument("model"), t.add_argument("--label", required=True)
    t.add_argument("--features"), t.add_argument("--weight"), t.add_argument("--key"), t.add_argument("--params", default=""), t.add_argument("--no-header", action="store_true")
    p = sub.add_parser("predict")
    p.add_argument("data"), p.add_argument("model"), p.add_argument("out"), p.add_argument("--kind", default="response"), p.add_argument("--no-header", action="store_true")
    i = sub.add_parser("info")
    i.add_argument("model")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "info":
        m = io.load(spark, a.model)
        said = {"trees": len(m.trees), "outputs": m.outputs, "features": m.features, "objective": m.params.objective, "leaves": sum(n["feature"] is None for x in m.trees for n in x)}
    elif a.command == "train":
        df = read(spark, a.data, not a.no_header)
        names = a.features.split(",") if a.features else [c for c in df.columns if c not in (a.label, a.weight, a.key)]
        m = train(df, names, a.label, Params.parse(a.params), a.weight, a.key)
        io.save(spark, m, a.model)
        said = {"trees": len(m.trees), "features": len(names)}
    else:
        out = io.load(spark, a.model).predict(read(spark, a.data, not a.no_header), a.kind)
        io.write_predictions(out, a.out, "leaf" if a.kind == "leaf" else "prediction")
        said = {"rows": spark.read.text(a.out).count()}
    print(json.dumps(said))
    return said


if __name__ == "__main__":
    main()
