"""Run a job: ``python -m citesift build|evaluate|update``.

``build`` makes the article table from retrieved records, fetched pages, optional
supplementary articles and the list of relevant titles. ``evaluate`` cross-validates
and writes report, curves and scores. ``update`` writes the ranked tables of new and
of misclassified articles. Queries are a JSON list of ``[name, [[term, ...], ...]]``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from citesift.operators.articles import CUTOFF_DATE
from citesift.operators.model import even_grid
from citesift.operators.retrieval import Query
from citesift.plans import build, evaluate, update
from citesift.session import scratch_scope
from citesift.sources import articles as files


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="citesift", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    make = jobs.add_parser("build")
    make.add_argument("--retrieved", required=True, help="parquet of retrieved records")
    make.add_argument("--pages", required=True, help="parquet of url and html")
    make.add_argument("--url-prefix", required=True)
    make.add_argument("--extra", help="JSON map of supplementary articles")
    make.add_argument("--titles", required=True, help="pipe-separated file of relevant titles")
    make.add_argument("--escaped-titles", action="store_true", help="the titles were written by write_label_file")
    make.add_argument("--skip-title", action="append", default=[])
    for name in ("evaluate", "update"):
        job = jobs.add_parser(name)
        job.add_argument("--articles", required=True, help="stored article table")
        job.add_argument("--queries", required=True, help="JSON file of boolean queries")
        job.add_argument("--features", choices=("simple", "full"), default="simple")
        job.add_argument("--grid-points", type=int, default=200, help="values of C to try, 0 for no search")
        job.add_argument("--store", help="keep each finished fold here, and go on from those that are there")
        job.add_argument("--parts", type=int, help="parts to work on texts in, for tables of few files")
    job.add_argument("--slices", type=int, help="files of each ranked table; by default as many as the session shuffles in")
    for job in jobs.choices.values():
        job.add_argument("--out", required=True)
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName(f"citesift-{args.job}").getOrCreate()
    # All results are written when a job ends; its scratch tables go.
    with scratch_scope(spark):
        _run(spark, args)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "build":
        scraped = build.articles_from_pages(
            spark.read.parquet(args.retrieved), spark.read.parquet(args.pages), args.url_prefix
        )
        columns = ("url", "publication_date", "publication_types", "title", "abstract", "ord")
        # Without a supplementary file the first source is empty.
        extra = files.read_json_map(spark, args.extra) if args.extra else scraped.limit(0).withColumnRenamed("ord", "article_key")
        extra = extra.withColumnRenamed("article_key", "ord").select(*columns)
        titles = files.read_label_file(spark, args.titles, args.escaped_titles)
        files.write_articles(build.build_articles(scraped, extra, titles, args.skip_title), args.out)
        return
    with open(args.queries, encoding="utf-8") as handle:
        queries = [Query(name, tuple(tuple(group) for group in groups)) for name, groups in json.load(handle)]
    old = build.prepare(files.read_articles(spark, args.articles, before=CUTOFF_DATE))
    grid = even_grid(args.grid_points) if args.grid_points else None
    settings = evaluate.Settings(args.features, grid=grid, parts=args.parts, tasks=args.parts)
    result = evaluate.cross_validate(old, queries, settings, args.store)
    if args.job == "evaluate":
        evaluate.save_performance(result, args.out, settings)
    else:
        new = build.prepare(files.read_articles(spark, args.articles, since=CUTOFF_DATE, undated=True))
        scores = update.score_new(old, new, queries, args.features, parts=args.parts)
        update.save_tables(scores, new, result.scores, old, args.out, args.slices)


if __name__ == "__main__":
    main()
