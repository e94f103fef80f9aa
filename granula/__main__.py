"""python -m granula: evaluate, ablate or vary the parameters on benchmark sets."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from granula.plans import pipelines
from granula.sources import io


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    ask = argparse.ArgumentParser(prog="granula", description=__doc__)
    ask.add_argument("--base-dir", required=True, help="folder of <name>.txt and <name>_label.txt")
    ask.add_argument("--datasets", nargs="*", default=list(io.DATASETS))
    ask.add_argument("--study", choices=["run", "incremental", "remove-one", "sensitivity"], default="run")
    ask.add_argument("--config", choices=list(pipelines.CONFIGS), default="adaptive_dpc")
    ask.add_argument("--distance-threshold", type=float, default=0.0)
    ask.add_argument("--output-csv")
    args = ask.parse_args(argv)
    spark = spark or SparkSession.builder.appName("granula").getOrCreate()
    base = replace(pipelines.CONFIGS[args.config], distance=args.distance_threshold)
    settings = {name: {"k": k, "scaler": scaler} for name, (k, scaler) in io.DATASETS.items()}
    load = lambda name: io.open_dataset(spark, args.base_dir, name)
    if args.study == "run":
        rows = [x | {"dataset": x["name"]} for x in pipelines.run_all(load, args.datasets, base, settings)]
    else:
        study = {"incremental": lambda p, c: pipelines.ablate(p, c, pipelines.INCREMENTAL), "remove-one": pipelines.ablate, "sensitivity": pipelines.sensitivity}[args.study]
        rows = [x | {"dataset": name} for name in args.datasets for x in study(load(name), replace(base, **settings[name]))]
    print(io.text_table(rows, ["dataset", "name", "acc", "nmi", "ari", "granules", "seconds", "error"]))
    if args.output_csv:
        io.write_results(io.results(spark, rows), args.output_csv)
    return rows


if __name__ == "__main__":
    main()
