"""python -m palimgraph: preprocess dumps, load tables, query them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .serving import results
from .sources import dump, tables
from .store import HistoryStore


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser("palimgraph", description=__doc__)
    a.add_argument("-p", "--preprocess", action="store_true", help="XML dumps to tables of revisions and triples")
    a.add_argument("-l", "--load", action="store_true", help="tables to a sorted store")
    a.add_argument("-q", "--sparql", help="a query to answer as tab-separated values")
    a.add_argument("-dd", "--dumps-dir", default="dumps")
    a.add_argument("-pd", "--preprocessed-dir", default="preprocessed")
    a.add_argument("-id", "--index-dir", default="index")
    a.add_argument("-t", "--triples-only", action="store_true")
    a.add_argument("-wdt", "--wdt-only", action="store_true")
    a.add_argument("--property-info", help="Parquet table (pid, datatype, uri_pattern)")
    a.add_argument("--sites", help="Parquet table (site_key, url_template, language, site_group)")
    o = a.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.preprocess:
        pages = dump.read_pages(spark, o.dumps_dir)
        side = {k: spark.read.parquet(p) for k, p in (("property_info", o.property_info), ("sites", o.sites)) if p}
        tables.write_lines(tables.revision_lines(dump.revisions(pages)), f"{o.preprocessed_dir}/revisions.tsv.gz")
        tables.write_lines(tables.triple_lines(dump.triples(pages, **side)), f"{o.preprocessed_dir}/triples.tsv.gz")
    if o.load:
        triples = tables.read_triples(spark, f"{o.preprocessed_dir}/triples.tsv.gz", direct_only=o.wdt_only)
        revisions = None if o.triples_only else tables.read_revisions(spark, f"{o.preprocessed_dir}/revisions.tsv.gz")
        HistoryStore(spark, triples, revisions).save(o.index_dir)
    if o.sparql:
        sys.stdout.writelines(results.tsv_rows(HistoryStore.open(spark, o.index_dir).sparql(o.sparql)))


if __name__ == "__main__":
    main()
