"""python -m weftline.cli run --config FILE ...: one generation from a data set to a versioned table."""

from __future__ import annotations

import argparse

from weftline.settings import load_config, same_dataset


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    # The flags of the command line.
    run = sub.add_parser("run", help="make the next generation")
    run.add_argument("--config", required=True)
    run.add_argument("--num-seeds", type=int)
    run.add_argument("--seed", type=int)
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--push-to-hub", action="store_true", help="publish the rows to the output table; can only switch it on")
    run.add_argument("--dataset-id")
    run.add_argument("--wave", type=int)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from weftline.operators.completions import StubCompleter
    from weftline.plans.evolve import evolve
    from weftline.runtime import prepare
    from weftline.sources import tables

    cfg = load_config(a.config)
    cfg.runtime.dry_run = cfg.runtime.dry_run or a.dry_run
    spark = prepare(SparkSession.builder.appName("weftline").getOrCreate())
    table = tables.VersionedTable(spark, cfg.input.dataset)
    source = table.read() if table.version() is not None else tables.scan(spark, cfg.input.dataset)
    result = evolve(source, cfg, StubCompleter(cfg.lineage.candidates_per_iteration), a.num_seeds, a.seed, a.wave)
    tables.write_jsonl(result.rows, cfg.output.local_path)
    tables.write_document(result.summary, cfg.output.summary_path)
    if a.push_to_hub or cfg.output.push_to_hub:
        target = a.dataset_id or cfg.output.dataset
        into = tables.VersionedTable(spark, target)
        if same_dataset(target, cfg.input.dataset) and into.version() is None:
            into.replace(source)
        tables.publish(into, result.rows, cfg, a.dataset_id)
    print(f"{result.summary['generated_rows']} generated, {result.summary['rejected_steps']} rejected, {len(result.summary['errors'])} errors; rows in {cfg.output.local_path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
