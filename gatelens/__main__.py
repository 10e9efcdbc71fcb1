"""Command line: ``spark-submit`` or ``python -m gatelens`` with list, run, generate, ingest, export and benchmark."""

from __future__ import annotations

import argparse
import subprocess
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gatelens").getOrCreate()


def _list(_) -> None:
    from gatelens.plans import catalogue

    print("\n".join(sorted(catalogue.queries())))


def _run(a) -> None:
    from gatelens.plans import catalogue

    df = catalogue.queries()[a.name](_session(), a.data)
    if a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        df.show(a.rows, False)


def _generate(a) -> None:
    from gatelens.operators import synthesis
    from gatelens.sources import graphs

    spark = _session()
    nodes, edges = synthesis.topology(spark, a.nodes, a.seed)
    for name in a.motifs:
        n, e = synthesis.inject(spark, name, 1)
        nodes, edges = nodes.unionByName(n.drop("motif_id", "tier"), True), edges.unionByName(e.drop("motif_id", "actions"), True)
    if a.form == "tables":
        nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    else:
        graphs.write_json({"structured": graphs.structured, "link": graphs.node_link}[a.form](nodes, edges), a.out, a.compress)


def _ingest(a) -> None:
    from gatelens.sources import terraform

    found = terraform.blocks(terraform.read_texts(_session(), a.directory, not a.flat)).cache()
    found.where("error is not null").select("path", "error").show(50, False)
    for name, df in zip(("nodes", "edges"), terraform.to_graph(found, a.account), strict=True):
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")


def _export(a) -> None:
    from gatelens.sources import graphs

    spark = _session()
    nodes, edges = graphs.read_json(spark, a.source)
    graphs.write_json({"structured": graphs.structured, "link": graphs.node_link}[a.form](nodes, edges), a.out, a.compress)


def _benchmark(_) -> None:
    sys.exit(subprocess.call([sys.executable, "bench.py"]))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gatelens", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, f, *arguments) -> None:
        c = sub.add_parser(name)
        c.set_defaults(f=f)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    forms = {"choices": ["structured", "link"], "default": "structured"}
    command("list", _list)
    command("run", _run, (["name"], {}), (["--data"], {"required": True}), (["--out"], {}), (["--format"], {"default": "parquet"}), (["--rows"], {"type": int, "default": 20}))
    command("generate", _generate, (["--nodes"], {"type": int, "default": 500}), (["--seed"], {"default": "0"}), (["--motifs"], {"nargs": "*", "default": []}), (["--form"], {"choices": ["tables", "structured", "link"], "default": "tables"}), (["--out"], {"required": True}), (["--compress"], {"action": "store_true"}))
    command("ingest", _ingest, (["directory"], {}), (["--out"], {"required": True}), (["--account"], {"default": "123456789012"}), (["--flat"], {"action": "store_true"}))
    command("export", _export, (["source"], {}), (["--form"], forms), (["--out"], {"required": True}), (["--compress"], {"action": "store_true"}))
    command("benchmark", _benchmark)
    a = p.parse_args(argv)
    a.f(a)


if __name__ == "__main__":
    main()
