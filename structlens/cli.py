"""Command line: python -m structlens.cli analyze GAMES.jsonl OUT [--robustness] | ingest OUT IDS... --documents FOLDER | refresh LANDING OUT."""

from __future__ import annotations

import argparse
import hashlib
from pathlib import Path

from structlens.plans import report
from structlens.session import build_session
from structlens.sources import files


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="structlens")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="report on a JSON Lines catalog")
    analyze.add_argument("games")
    analyze.add_argument("out")
    analyze.add_argument("--corpus", default="catalog")
    analyze.add_argument("--robustness", action="store_true", help="the robustness report too")
    ingest = commands.add_parser("ingest", help="ingest items by id, or the ids of a corpus list, from a folder of documents")
    ingest.add_argument("out")
    ingest.add_argument("ids", nargs="*")
    ingest.add_argument("--documents", required=True, help="folder of {id}.xml")
    ingest.add_argument("--ids-file", help="a corpus: one id a line; errors do not end the run")
    ingest.add_argument("--corpus", default="corpus")
    ingest.add_argument("--offset", type=int, default=0)
    ingest.add_argument("--limit", type=int)
    ingest.add_argument("--force", action="store_true", help="fetch again what is cached")
    refresh = commands.add_parser("refresh", help="take in new files of a landing folder")
    refresh.add_argument("landing")
    refresh.add_argument("out")
    chosen = parser.parse_args(arguments)
    if chosen.command == "ingest":
        if bool(chosen.ids) == bool(chosen.ids_file):
            parser.error("give ids or --ids-file")
        if not chosen.ids_file and (chosen.offset or chosen.limit is not None):
            parser.error("--offset and --limit go with --ids-file")
        if chosen.offset < 0 or chosen.limit is not None and chosen.limit < 0:
            parser.error("--offset and --limit must be 0 or more")
    spark = build_session(app="structlens-cli")
    if chosen.command == "refresh":
        from structlens.streaming import landing

        landing.keep_up(landing.landing_lines(spark, chosen.landing), chosen.out, f"{chosen.out}/_checkpoint").awaitTermination()
        return 0
    if chosen.command == "ingest":
        return _ingest(spark, chosen)
    from pyspark.sql import functions as F

    games, rejects = files.read_games(spark, chosen.games)
    games = games.withColumnRenamed("line_no", "row_seq")
    if games.isEmpty():
        return 1
    source = hashlib.sha256(Path(chosen.games).read_bytes()).hexdigest()
    made = report.build(games, chosen.corpus, [source])
    out = Path(chosen.out)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.json").write_bytes(report.json_bytes(made))
    (out / "findings.md").write_text(report.markdown(made))
    report.figures(made, str(out))
    if chosen.robustness:
        from structlens.plans import robustness

        tested = robustness.build(games, chosen.corpus, [source])
        (out / "robustness.json").write_bytes(report.json_bytes(tested))
        (out / "robustness.md").write_text(robustness.markdown(tested))
    print(f"{made['n_games']} records, {rejects.agg(F.count('*')).first()[0]} rejected lines")
    return 0


def _ingest(spark, chosen) -> int:
    import sys

    from structlens.errors import StructlensError
    from structlens.plans import ingest
    from structlens.sources.connector import FolderFetcher
    from structlens.sources.dictionary import CorpusSpec

    fetcher = FolderFetcher(chosen.documents)
    try:
        if chosen.ids_file:
            result = ingest.run_corpus(spark, chosen.out, fetcher, CorpusSpec(chosen.corpus, "1", chosen.ids_file), chosen.offset, chosen.limit, chosen.force)
        else:
            result = ingest.run(spark, chosen.out, fetcher, chosen.ids, chosen.force, go_on=False)
    except StructlensError as failure:
        print(f"error: {failure}", file=sys.stderr)
        return 1
    print("  ".join(f"{k}={v}" for k, v in result.counts.items()))
    return 1 if result.counts["requested"] and not result.counts["ok"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
