"""python -m lodestone inspect|verify|stats|diff|convert ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestone.functions.canonical import human_bytes
from lodestone.functions.tokenizers import get
from lodestone.operators import report
from lodestone.sources import readers
from lodestone.store import Corpus


def diff(a: Corpus, b: Corpus) -> int:
    """Print what differs; the number of things that do."""
    counts = report.diff(a.documents(), b.documents()).first()
    axes = {"format": (a.manifest["format"], b.manifest["format"]), "merkle root": (a.manifest["merkle_root"], b.manifest["merkle_root"]), "smt root": (a.manifest["smt_root"], b.manifest["smt_root"]), "views": (a.views(), b.views())}
    out = 0
    for name, (x, y) in axes.items():
        out += x != y
        print(f"{name}: {'same' if x == y else f'{x} / {y}'}")
    print(f"documents: {counts.shared} shared, {counts.only_a} only in the first, {counts.only_b} only in the second")
    for r in report.differing(a.documents(), b.documents()).collect():
        print(f"  {r.side} {bytes(r.doc_hash).hex()}")
    return out + bool(counts.only_a or counts.only_b)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "verify", "stats"):
        sub.add_parser(name).add_argument("path")
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("path")
    c.add_argument("--text-field", default="text")
    c.add_argument("--tokenizer", default="byte-level-v1")
    c.add_argument("--vocab", type=int, default=65_536)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "inspect":
        Corpus(spark, args.path, verify="none").inspect().show(100, truncate=False)
    elif args.command == "verify":
        checks = Corpus(spark, args.path, verify="none").checks(full=True)
        for name, ok, detail in checks:
            print("ok  " if ok else "FAIL", name, detail)
        return int(not all(ok for _, ok, _ in checks))
    elif args.command == "stats":
        for r in Corpus(spark, args.path, verify="none").stats().collect():
            print(f"{r.region:40} {human_bytes(r.bytes)}")
    elif args.command == "diff":
        return int(diff(Corpus(spark, args.a, verify="none"), Corpus(spark, args.b, verify="none")) > 0)
    else:
        settings = {"vocab_size": args.vocab} if args.tokenizer == "whitespace-hashed-v1" else {}
        Corpus.create(spark, args.path, readers.jsonl(spark, args.source, args.text_field).select("content", "source_ord"), [get(args.tokenizer, **settings)])
    return 0


if __name__ == "__main__":
    sys.exit(main())
