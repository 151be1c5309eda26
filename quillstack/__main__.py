"""python -m quillstack extract|clean|index|add|export|search|suggest|contains|barrels|stats"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import barrels, metrics, search, suggest
from quillstack.operators.analyze import CleanOptions
from quillstack.operators.index import SKIP_INTERVAL, Index
from quillstack.plans import jobs
from quillstack.sources import readers
from quillstack.sources.shared import written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstack", description="Index papers and search them.")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("extract", help="papers to rows")
    c.add_argument("paths", nargs="*", help="files")
    c.add_argument("-d", dest="folder")
    c.add_argument("-o", dest="out", required=True)
    c.add_argument("--jsonl")
    c = commands.add_parser("clean", help="rows to tokens")
    c.add_argument("-i", dest="source", required=True)
    c.add_argument("-if", dest="kind", choices=("tsv", "jsonl"), default="tsv")
    c.add_argument("-o", dest="out", required=True)
    c.add_argument("--stopwords")
    c.add_argument("--no-stopwords", action="store_true")
    c.add_argument("--stem", action="store_true")
    c.add_argument("--keep-original", action="store_true")
    c.add_argument("--remove-numbers", action="store_true")
    c.add_argument("--nfc", action="store_true")
    c.add_argument("--tokenizer", choices=("v1", "v2"), default="v1")
    c.add_argument("--dehyphenate", action="store_true", help="join words that a hyphen splits at a line's end")
    c.add_argument("--ascii-lower", action="store_true", help="lower case of A-Z alone")
    c.add_argument("--delete-tabs", action="store_true", help="tabs inside a text vanish, instead of being blanks")
    c.add_argument("--fields", default="title,abstract,sections")
    c = commands.add_parser("index", help="tokens to an index")
    c.add_argument("-i", dest="source", required=True)
    c.add_argument("-o", dest="out", required=True)
    c.add_argument("--skip-interval", type=int, default=SKIP_INTERVAL)
    c = commands.add_parser("add", help="tokens to an index that grows")
    c.add_argument("-i", dest="source", required=True)
    c.add_argument("-o", dest="out", required=True)
    c = commands.add_parser("export", help="an index to files of other programs")
    c.add_argument("index")
    c.add_argument("-o", dest="out", required=True)
    for name in ("search", "suggest"):
        c = commands.add_parser(name)
        c.add_argument("index")
        c.add_argument("query")
        c.add_argument("--top-k", type=int, default=search.TOP)
        if name == "search":
            c.add_argument("--single", action="store_true", help="by the first word alone")
            c.add_argument("--actual-tf", action="store_true")
            c.add_argument("--stem", action="store_true", help="stem the words, for an index of stems")
            c.add_argument("--synonyms", help="a file of term, synonym and rank, with tabs between: search with these too")
            c.add_argument("--any", action="store_true", help="any of words and synonyms, not all")
            c.add_argument("--metrics", help="write the search's time and memory there")
    c = commands.add_parser("contains", help="whether the index has a term")
    c.add_argument("index")
    c.add_argument("term")
    c = commands.add_parser("barrels", help="what each barrel holds")
    c.add_argument("index")
    commands.add_parser("stats").add_argument("index")
    return top


def run(spark: SparkSession, args: argparse.Namespace):  # noqa: ANN201
    """A DataFrame to show, or None."""
    if args.command == "extract":
        jobs.extract_papers(spark, [*args.paths, *([args.folder] if args.folder else [])], args.out, args.jsonl)
    elif args.command == "clean":
        stop = None if args.no_stopwords else readers.stopwords(spark, args.stopwords) if args.stopwords else CleanOptions().stopwords
        options = CleanOptions(args.fields.split(","), stop, args.stem, args.keep_original, args.remove_numbers, args.tokenizer, args.ascii_lower, args.dehyphenate, not args.delete_tabs, args.nfc)
        jobs.clean_rows(spark, args.source, args.kind, args.out, options)
    elif args.command == "index":
        return jobs.index_cleaned(spark, args.source, args.out, args.skip_interval).stats()
    elif args.command == "add":
        return jobs.add_cleaned(spark, args.source, args.out).index().stats()
    else:
        found = jobs.load(spark, args.index)
        if args.command == "export":
            jobs.export(found, args.out)
        elif args.command == "stats":
            return found.stats()
        elif args.command == "suggest":
            if found.completions is None:
                return suggest.suggest_with_freq(found.lexicon, args.query, args.top_k)
            return suggest.complete(found.completions, found.lexicon, args.query, args.top_k)
        elif args.command == "contains":
            return suggest.contains(found.lexicon, args.term)
        elif args.command == "barrels":
            return barrels.metadata(found.lexicon).orderBy("barrel_id")
        else:
            return searched(spark, found, args)
    return None


def searched(spark: SparkSession, found: Index, args: argparse.Namespace) -> DataFrame:
    """The results of one search; with metrics, computed here and timed."""
    tf_mode = "actual" if args.actual_tf else "binary"
    if args.synonyms or args.any:
        listed = spark.read.schema("term string, synonym string, rank int").option("sep", "\t").option("quote", "").csv(args.synonyms) if args.synonyms else None
        scored = search.search_semantic(found, args.query, listed, args.top_k, "or" if args.any else "and", tf_mode)
    elif args.single:
        scored = search.search_single(found, args.query, args.top_k, tf_mode)
    else:
        words = search.tokenize(args.query)
        if args.stem:
            from quillstack.functions.stem import stem

            words = [stem(w) for w in words]
        scored = search.bounded(found, words, "and", tf_mode, args.top_k)
    results = search.results(found, scored)
    if args.metrics:
        monitor = metrics.PerformanceMonitor()
        with monitor.query():
            results = written(results, "results").orderBy(F.desc("score"), "doc_id")
        monitor.save(spark, args.metrics)
    return results


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("quillstack").getOrCreate()
    shown = run(spark, args)
    if shown is not None:
        shown.show(1000, truncate=False)


if __name__ == "__main__":
    main()
