"""Command line: ``python -m seqlattice static|interactive --fasta a.fa b.fa.gz --output-dir out [options]``."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .plans import run
from .plans.params import IdentityQuery
from .sources import readers


def parser() -> argparse.ArgumentParser:
    """An option for each field of :class:`IdentityQuery`, named as it is; repeated values follow one another."""
    out = argparse.ArgumentParser(prog="seqlattice")
    out.add_argument("run", choices=["static", "interactive"])
    out.add_argument("-c", "--config", help="JSON file whose keys override the options")
    kinds = {"int": int, "float": float, "str": str}
    for field in dataclasses.fields(IdentityQuery):
        kind = str(field.type)
        name = "--" + field.name.replace("_", "-")
        if kind == "bool":
            out.add_argument(name, action="store_true")
        elif kind.startswith("tuple"):
            out.add_argument(name, nargs="+", default=list(field.default), type=kinds[kind.removeprefix("tuple[").split(",")[0]])
        else:
            out.add_argument(name, default=field.default, type=kinds[kind.split(" ")[0]])
    return out


def query(args: list[str] | None = None) -> tuple[str, IdentityQuery]:
    given = vars(parser().parse_args(args))
    which, config = given.pop("run"), given.pop("config")
    made = IdentityQuery(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    return which, readers.config(config, made) if config else made


def main(args: list[str] | None = None) -> None:
    which, options = query(args)
    run.execute(SparkSession.builder.appName("seqlattice").getOrCreate(), options, which == "interactive")


if __name__ == "__main__":
    main()
