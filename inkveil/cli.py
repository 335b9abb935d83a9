"""Command line: `python -m inkveil.cli mask FILE...` and `python -m inkveil.cli unmask FILE...`."""

from __future__ import annotations

import argparse
import glob
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .sources import files, formats, mappings


def expanded(patterns: list[str]) -> list[str]:
    """Files of the patterns, in order; a pattern without a match stands for itself."""
    return [path for pattern in patterns for path in sorted(glob.glob(pattern, recursive=True)) or [pattern]]


def _refused(paths: list[str], known) -> int:
    bad = [p for p in paths if not Path(p).is_file() or Path(p).suffix.lower() not in known]
    for path in bad:
        print(f"{path}: " + ("no such file" if not Path(path).is_file() else "unknown format"), file=sys.stderr)
    return len(bad)


def _write(rows, name) -> None:
    for row in rows.toLocalIterator():
        target = Path(name(Path(row["path"].removeprefix("file:").replace("//", "/")), row["ext"]))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(bytes(row["content"]))


def mask(spark: SparkSession, paths: list[str], output: str | None = None, mapping: str | None = None) -> int:
    """Files are masked in one session with a common mapping, or each with its own beside it."""
    good = [p for p in paths if not _refused([p], formats.FORMATS)]
    for group in [good] if mapping else [[p] for p in good]:
        if not group:
            continue
        target = mapping or str(Path(group[0]).with_name(f"{Path(group[0]).stem}_mapping.tsv"))
        known = mappings.load(spark, target) if Path(target).exists() else None
        out, labels = files.mask_files(files.read(spark, [str(Path(p).absolute()) for p in group]), known)
        labels = labels.cache()
        _write(out, lambda p, ext: output if output and len(paths) == 1 else p.with_name(f"{p.stem}_masked{ext}"))
        mappings.save(labels, target)
    return int(len(good) < len(paths))


def unmask(spark: SparkSession, paths: list[str], output: str | None = None, mapping: str | None = None) -> int:
    failed = _refused(paths, formats.RESTORABLE)
    for path in paths:
        file = Path(path)
        stem = file.stem.removesuffix("_masked")
        table = mapping or str(file.with_name(f"{stem}_mapping.tsv"))
        if _refused([path], formats.RESTORABLE):
            continue
        if not Path(table).exists():
            print(f"{path}: no mapping {table}", file=sys.stderr)
            failed += 1
            continue
        out = files.restore_files(files.read(spark, [str(file.absolute())]), mappings.load(spark, table))
        _write(out, lambda p, ext: output if output and len(paths) == 1 else p.with_name(f"{p.stem.removesuffix('_masked')}_restored{p.suffix}"))
    return int(failed > 0)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    commands = {"mask": mask, "unmask": unmask}
    arguments = sys.argv[1:] if arguments is None else arguments
    # a program of a command's name is that command
    if (name := Path(sys.argv[0]).stem) in commands:
        arguments = [name, *arguments]
    parser = argparse.ArgumentParser(prog="inkveil")
    parser.add_argument("command", choices=list(commands))
    parser.add_argument("files", nargs="+")
    parser.add_argument("-o", "--output")
    parser.add_argument("-m", "--mapping")
    asked = parser.parse_args(arguments)
    session = spark or SparkSession.builder.appName("inkveil").getOrCreate()
    return commands[asked.command](session, expanded(asked.files), asked.output, asked.mapping)


if __name__ == "__main__":
    sys.exit(main())
