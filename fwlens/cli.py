"""Command line: build a database of library objects, or match a target against one."""

from __future__ import annotations

import argparse
import sys

from fwlens.plans.engine import Engine, Options
from fwlens.session import session
from fwlens.sources.binaries import object_files
from fwlens.sources.exports import symbol_yaml
from fwlens.sources.tables import build_database, load_tables, write_tables
from fwlens.sources.targets import LoadOptions, cortex_options, load_target


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fwlens", description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("-U", "--match", action="store_true", help="match a target")
    mode.add_argument("-B", "--build", action="store_true", help="build a database from a tree of objects, a folder for each library")
    p.add_argument("infile", help="lifted tables of the target, or the tree of objects")
    p.add_argument("outfile", nargs="?", help="where the database or the symbol file goes")
    p.add_argument("-L", "--database", help="the database to match against")
    p.add_argument("--lifted", help="build: lifted tables of the objects")
    p.add_argument("--base-address", type=lambda x: int(x, 0))
    p.add_argument("--entry-point", type=lambda x: int(x, 0))
    p.add_argument("--arch")
    p.add_argument("--cortex", metavar="IMAGE", help="take base and entry from an image's header")
    p.add_argument("--scoring", action="store_true", help="also score against the target's own symbols")
    p.add_argument("-Y", "--yaml", action="store_true", help="write a symbol file")
    p.add_argument("--max-phase", type=int, default=5, choices=range(1, 6))
    p.add_argument("--min-similarity", type=float)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    o = p.parse_args(argv)
    if o.match and not o.database:
        p.error("-U needs -L")
    if o.build and not (o.lifted and o.outfile):
        p.error("-B needs --lifted and a place for the database")
    spark = session()
    if o.build:
        tables, bad = build_database(load_tables(spark, o.lifted), object_files(spark, o.infile))
        write_tables(tables, o.outfile)
        bad.write.parquet(f"{o.outfile}/bad_objects")
        return 0
    options = cortex_options(spark, o.cortex) if o.cortex else LoadOptions(o.base_address, o.entry_point, o.arch)
    target = load_target(load_tables(spark, o.infile), options)
    if target is None:
        print("the target can't be loaded", file=sys.stderr)
        return 1
    engine = Engine(load_tables(spark, o.database), Options(max_phase=o.max_phase, min_similarity=o.min_similarity))
    result = engine.match(target).result(scored=o.scoring)
    if o.scoring:
        result.scores.show(truncate=False)
    if o.yaml:
        image = target.objects.first()
        text = symbol_yaml(result.names, image["arch"] or "unknown", options.base or image["base_addr"] or 0, options.entry or image["entry"] or 0)
        if o.outfile:
            with open(o.outfile, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
