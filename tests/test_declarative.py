"""The declarative form registers the same three datasets (not run: needs Spark Connect)."""

import importlib.util
from pathlib import Path

from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context

ROOT = Path(__file__).resolve().parents[1] / "declarative"


class Recorder(GraphElementRegistry):
    def __init__(self):
        self.outputs, self.flows = [], []

    def register_output(self, output):
        self.outputs.append(output)

    def register_flow(self, flow):
        self.flows.append(flow)

    def register_sql(self, sql_text, file_path):
        raise AssertionError("no SQL files expected")


def test_registration(spark, workdir):
    rec = Recorder()
    with graph_element_registration_context(rec):
        for f in sorted((ROOT / "transformations").glob("*.py")):
            spec = importlib.util.spec_from_file_location(f.stem, f)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
    names = {o.name: type(o).__name__ for o in rec.outputs}
    assert names == {
        "bronze_customers": "StreamingTable",
        "bronze_orders": "StreamingTable",
        "silver_customer_summary": "MaterializedView",
    }
    assert {f.target for f in rec.flows} == set(names)
    spark.conf.set("strata.landing.customers", workdir)
    spark.conf.set("strata.landing.orders", workdir)
    bronze = {f.target: f.func() for f in rec.flows if f.target.startswith("bronze")}
    assert all(df.isStreaming for df in bronze.values())
    assert "spark-pipeline" in {p.stem for p in ROOT.glob("*.yml")}


def test_spec_names_a_catalog_and_a_storage_with_a_scheme():
    spec = dict(line.split(": ", 1) for line in (ROOT / "spark-pipeline.yml").read_text().splitlines() if ": " in line and line[0].isalpha())
    assert "://" in spec["storage"] and spec["catalog"]
