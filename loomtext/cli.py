"""Command line: convert text files, pages, packages; build dictionaries. Exit codes: 0 done, 1 failed, 130 stopped."""

from __future__ import annotations

import argparse
import os
import sys

from .plans.configs import supported_configs
from .plans.slots import CustomSpec
from .sources.dictionaries import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def common(c: argparse.ArgumentParser, config_needed: bool = True) -> None:
        c.add_argument("-i", "--input", required=True)
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-c", "--config", required=config_needed, choices=supported_configs(), type=str.lower)
        c.add_argument("-p", "--punct", action="store_true")
        c.add_argument("--custom", action="append", default=[], metavar="SLOT:MODE:PATH")

    c = sub.add_parser("convert", help="text files")
    common(c)
    c.add_argument("--in-enc", default="utf-8")
    c.add_argument("--out-enc", default="utf-8")
    c.add_argument("--preserve-ids", action="store_true")
    c.add_argument("--norm-compat", action="store_true")
    c.add_argument("--extended", action="store_true")
    c.add_argument("--detofu", metavar="LEVEL")

    c = sub.add_parser("pages", help="a Parquet table (doc_id, page_no, text)")
    common(c, config_needed=False)
    c.add_argument("-r", "--reflow", action="store_true")
    c.add_argument("-H", "--header", action="store_true")
    c.add_argument("--compact", action="store_true")
    c.add_argument("--extract", action="store_true", help="no conversion")
    c.add_argument("--norm-compat", action="store_true")

    c = sub.add_parser("office", help="office and EPUB packages")
    common(c)
    c.add_argument("--keep-font", action=argparse.BooleanOptionalAction, default=True)

    c = sub.add_parser("dictgen", help="one file of all dictionaries: .json, .zstd or .cbor")
    c.add_argument("-b", "--base-dir")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--custom", action="append", default=[], metavar="SLOT:MODE:PATH")
    return p


def _run(args: argparse.Namespace) -> None:
    specs = [CustomSpec.parse(x) for x in args.custom]
    if args.command == "dictgen":
        load(args.base_dir).with_custom(*specs).save(args.output)
        return
    if os.path.abspath(args.input) == os.path.abspath(args.output):
        raise ValueError("input and output are the same")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.office import convert_packages, read_packages, write_packages
    from .operators.pipeline import convert_pipeline, page_pipeline
    from .sources.text import read_text, write_encoded

    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    dicts = load().with_custom(*specs) if specs else None
    if args.command == "convert":
        rows = read_text(spark, args.input, args.in_enc)
        text = convert_pipeline(F.col("text"), args.config, args.punct, args.preserve_ids, args.norm_compat, args.extended, args.detofu, dicts=dicts)
        write_encoded(rows.select(text.alias("text")), "text", args.output, args.out_enc)
    elif args.command == "pages":
        config = None if args.extract else args.config
        page_pipeline(spark.read.parquet(args.input), config, args.punct, args.reflow, args.header, args.compact, args.norm_compat, dicts).write.parquet(args.output)
    else:
        done = convert_packages(read_packages(spark, args.input), args.config, args.punct, args.keep_font, dicts).cache()
        failed = done.where("NOT success").select("path", "message").take(20)
        write_packages(done, args.output)
        if failed:
            raise RuntimeError("; ".join(f"{r.path}: {r.message}" for r in failed))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        _run(args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the message is all that a shell needs
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
