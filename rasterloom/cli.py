"""Command line: ``python -m rasterloom.cli SOURCE -o TARGET``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from rasterloom.plans import sheets
from rasterloom.plans.config import CHOICES, Config
from rasterloom.session import build_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rasterloom", description="Make colour-by-number sheets of all images below a path.")
    out.add_argument("source")
    out.add_argument("-o", "--output", required=True)
    out.add_argument("--overwrite", action="store_true")
    out.add_argument("--compare-strategies", action="store_true")
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        names = ["-k", flag] if f.name == "colors" else [flag]
        if isinstance(f.default, bool):
            out.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            out.add_argument(*names, type=type(f.default), default=f.default, choices=CHOICES.get(f.name))
    return out


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    try:
        config = Config.from_mapping(args).checked()
        spark = build_session("rasterloom")
        if args["compare_strategies"]:
            from rasterloom.sources.images import read_pixels

            sheets.export_comparison(read_pixels(spark, args["source"], config.max_side), args["output"], config, args["overwrite"]).show(truncate=False)
        else:
            sheets.run_images(spark, args["source"], args["output"], config, args["overwrite"])
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
