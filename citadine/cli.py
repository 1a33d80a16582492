"""Command line: run or list queries over a folder of tables, or a step of the chain over a city's settings.

    python -m citadine.cli list
    python -m citadine.cli query density_field /root/testdata/sf0.01 --out /tmp/field
    python -m citadine.cli hotspots --config config.yaml --dataset chicago
    python -m citadine.cli index --config config.yaml --out datasets.json
"""

from __future__ import annotations

import argparse

from citadine import session

#: Options of the commands and their defaults.
OPTIONS = {"min-iou": 0.2, "max-gap": 3, "movement-cutoff-m": 3000.0, "pairs": 25, "min-ratio": 3.0, "realisations": 10, "parents": 15, "offspring": 200, "background": 100, "subnetwork": 400, "seed": 20200}


def parser() -> argparse.ArgumentParser:
    from citadine.commands import COMMANDS

    out = argparse.ArgumentParser(prog="citadine", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    query = commands.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out", help="write Parquet here instead of showing rows")
    index = commands.add_parser("index", help="which data sets have their artifacts")
    index.add_argument("--config", required=True)
    index.add_argument("--out", required=True)
    for name, f in COMMANDS.items():
        own = commands.add_parser(name, help=f.__doc__.splitlines()[0])
        own.add_argument("--config", required=True)
        own.add_argument("--dataset")
        own.add_argument("--no-pois", action="store_true")
        own.add_argument("--sigma", type=float)
        for option, default in OPTIONS.items():
            own.add_argument(f"--{option}", type=type(default), default=default)
    return out


def main(argv: list[str] | None = None) -> int:
    own = parser()
    args = own.parse_args(argv)
    from citadine.commands import COMMANDS
    from citadine.plans import catalog
    from citadine.sources import artifacts, config

    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if args.command == "index":
        known = {name: config.load(args.config, name) for name in config.datasets(args.config)}
        about = {name: {"dir": s.file("data.processed_dir"), "label": s.get("label", name), "sublabel": s.get("sublabel", ""), "place": s.get("network.place", "")} for name, s in known.items()}
        artifacts.write_json(artifacts.dataset_index(about, config.load(args.config).name), args.out, 2)
        return 0
    spark = session.local()
    if args.command == "query":
        known = catalog.queries()
        if args.name not in known:
            own.error(f"unknown query {args.name!r}")
        found = known[args.name](spark, args.folder)
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            found.show(50, truncate=False)
        return 0
    from citadine.city import City

    print(COMMANDS[args.command](City(spark, config.load(args.config, args.dataset)), args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
