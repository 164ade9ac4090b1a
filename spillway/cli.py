"""Command line: generate, split, merge, check and sort files of fixed-size records.

Actions: gen, spl, mrg, chk, srt (spl and mrg) and all (gen, srt and chk).
"""

from __future__ import annotations

import argparse
import contextlib
import glob
import logging
import os
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError

from spillway.operators.merge import merge
from spillway.operators.order import sort
from spillway.operators.runs import split
from spillway.operators.verify import check, first_violations, same_rows
from spillway.plans.params import GenerateParams, MemoryParams, MergeParams
from spillway.plans.spec import NAMED, U32, Ordering, RecordSpec
from spillway.sources.binary import count_records, read_records, reading, run_file, write_records, write_run_files

log = logging.getLogger("spillway")
#: Levels of --log, from 0: none, fatal, errors, warnings, important, information, low, debug.
LEVELS = (logging.CRITICAL + 1, logging.CRITICAL, logging.ERROR, logging.WARNING, 25, logging.INFO, 15, logging.DEBUG)
IMPORTANT = LEVELS[4]
STEPS = {"gen": "g", "spl": "s", "mrg": "m", "chk": "c", "srt": "sm", "all": "gsmc"}


@dataclass(frozen=True)
class Paths:
    """Files of each step, after defaults."""

    generated: str
    split_in: str
    runs: str
    merge_in: tuple[str, ...]
    merged: str
    checked: str


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spillway", description=__doc__)
    p.add_argument("--act", choices=STEPS, default="all")
    p.add_argument("--spec", default="u32", help="u32, named, or fields such as id:uint32,name:char[32]")
    p.add_argument("--key", help="columns to order by, comma-separated, descending with a leading minus; the first field by default")
    p.add_argument("--msize", type=int, default=1, help="memory for a sort, in --munit")
    p.add_argument("--munit", choices=("B", "K", "M"), default="M")
    p.add_argument("--mrg.merges", "--merges", dest="merges", type=int, default=4)
    p.add_argument("--mrg.kmerge", "--kmerge", dest="kmerge", type=int, default=4)
    p.add_argument("--mrg.stmblocks", "--stmblocks", dest="stmblocks", type=int, default=2)
    p.add_argument("--tmpdir", default="", help="folder of the runs")
    p.add_argument("--srt.ifile", dest="sort_in", default="")
    p.add_argument("--srt.ofile", dest="sort_out", default="")
    p.add_argument("--gen.ofile", dest="gen_out", default="generated")
    p.add_argument("--gen.fsize", dest="gen_size", type=int, help="size of the generated file, in --munit; 16 times --msize by default")
    p.add_argument("--gen.blocks", dest="gen_blocks", type=int, default=2, help="blocks in memory (checked only; Spark manages memory)")
    p.add_argument("--gen.seed", dest="seed", type=int, default=0)
    p.add_argument("--spl.ifile", dest="split_in", default="")
    p.add_argument("--spl.ofile", dest="split_out", default="")
    p.add_argument("--spl.blocks", "--blocks", dest="blocks", type=int, default=2, help="blocks in memory: a run is --msize over it")
    p.add_argument("--mrg.ifiles", dest="merge_in", default="", help="comma-separated")
    p.add_argument("--mrg.ofile", dest="merge_out", default="")
    p.add_argument("--chk.ifile", dest="check_in", default="")
    p.add_argument("--chk.blocks", dest="check_blocks", type=int, default=2, help="blocks in memory (checked only)")
    p.add_argument("--rm-input", dest="remove", action="store_true", help="delete the runs once they are merged")
    p.add_argument("--no_rm", dest="keep", action="store_true", help="keep the runs whatever --rm-input says; they are kept by default")
    p.add_argument("--strict-empty", dest="strict", action="store_true", help="fail if there is nothing to sort or merge")
    p.add_argument("--log", type=int, default=4, help="0 (nothing) to 6 (nearly everything); 4 for any other number")
    return p


def resolve(a: argparse.Namespace) -> Paths:
    """Files that were not named follow from those that were."""
    steps = STEPS[a.act]
    split_in = a.split_in or a.sort_in or (a.gen_out if "g" in steps or a.act == "srt" or "s" in steps else "")
    base = os.path.join(a.tmpdir, os.path.basename(split_in)) if a.tmpdir else split_in
    runs = a.split_out or base
    merge_in = tuple(x for x in a.merge_in.split(",") if x)
    if steps == "m" and not (merge_in and (a.merge_out or a.sort_out)):
        raise SystemExit("mrg needs --mrg.ifiles and --mrg.ofile")
    merged = a.merge_out or a.sort_out or f"{split_in}.sorted"
    return Paths(a.gen_out, split_in, runs, merge_in, merged, a.check_in or (merged if "m" in steps else a.sort_in or a.gen_out))


def level(n: int) -> int:
    return LEVELS[n] if 0 <= n <= 6 else IMPORTANT


def log_parameters(a: argparse.Namespace) -> None:
    """Every option with its value, one a line, sorted."""
    for name, value in sorted(vars(a).items()):
        log.info("%s = %s", name, value if value not in ("", None) else "<none>")


def cpu_seconds(spark: SparkSession, group: str) -> float:
    """CPU seconds of the JVM's tasks of a job group, on all executors."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
    total = 0
    for stage in {s for j in jobs for s in j.stageIds}:
        # Stages that were skipped have no attempt.
        with contextlib.suppress(Py4JJavaError):
            total += store.lastStageAttempt(stage).executorCpuTime()
    return total / 1e9


@contextlib.contextmanager
def timed(spark: SparkSession, what: str, totals: list[float]) -> Iterator[None]:
    """Logs wall seconds, and CPU seconds of the driver's Python and of the tasks; adds them to totals."""
    group, context = f"spillway-{what}-{time.time_ns()}", spark.sparkContext
    context.setJobGroup(group, what)
    wall, own = time.perf_counter(), time.process_time()
    try:
        yield
    finally:
        spent = [time.perf_counter() - wall, time.process_time() - own, cpu_seconds(spark, group)]
        for i, x in enumerate(spent):
            totals[i] += x
            context.setLocalProperty(("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")[i], None)
        log.log(IMPORTANT, "%s: %.2f s, CPU %.2f s (driver) and %.2f s (tasks)", what, *spent)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(message)s")
    for number, name in ((25, "IMPORTANT"), (15, "LOW")):
        logging.addLevelName(number, name)
    log.setLevel(level(a.log))
    log_parameters(a)
    spec = {"u32": U32, "named": NAMED}.get(a.spec) or RecordSpec.parse(a.spec)
    ordering = Ordering.of(*a.key.split(",")) if a.key else spec.order()
    memory, merging = MemoryParams(a.msize, a.munit, a.blocks), MergeParams(a.merges, a.kmerge, a.stmblocks)
    for blocks in (a.gen_blocks, a.check_blocks):
        MemoryParams(a.msize, a.munit, blocks)
    steps, paths = STEPS[a.act], resolve(a)
    spark = SparkSession.builder.appName("spillway").getOrCreate()
    totals = [0.0, 0.0, 0.0]
    made: list[str] = []
    ok = True
    for step, what in (("g", "generate"), ("s", "split"), ("m", "merge"), ("c", "check")):
        if step not in steps:
            continue
        with timed(spark, what, totals):
            if step == "g":
                n = GenerateParams(a.gen_size if a.gen_size is not None else 16 * a.msize, a.munit, a.seed).records(spec.record_size)
                write_records(spec.generate(spark, n, a.seed), paths.generated, spec, single="true")
            elif step == "s":
                made = split_file(spark, paths.split_in, paths.runs, spec, ordering, memory.block_records(spec.record_size))
                log.log(IMPORTANT, "%d runs, %d merges", len(made), merging.merge_count(len(made)))
            elif step == "m":
                inputs = list(paths.merge_in) or made
                if not inputs and "s" not in steps:
                    inputs = sorted(glob.glob(f"{glob.escape(paths.runs)}.split.*"))
                merge_files(spark, inputs or [paths.split_in], paths.merged, spec, ordering, a.remove and not a.keep and bool(inputs), a.strict)
            else:
                ok = check_file(spark, paths.checked, spec, ordering, paths.split_in if "s" in steps and "m" in steps else None)
    log.log(IMPORTANT, "overall: %.2f s, CPU %.2f s (driver) and %.2f s (tasks)", *totals)
    if not ok:
        log.error("The file is NOT sorted")
    return 0 if ok else 2


def split_file(spark: SparkSession, source: str, prefix: str, spec: RecordSpec, ordering: Ordering, block_records: int) -> list[str]:
    """Sorted runs of a file, all written by one job; their names."""
    df = read_records(spark, source, spec)
    write_run_files(split(df, "pos", block_records, ordering.over(df.drop("pos"))), prefix, spec)
    return [run_file(prefix, r) for r in range(1, -(-count_records(source, spec) // block_records) + 1)]


def merge_files(spark: SparkSession, sources: list[str], target: str, spec: RecordSpec, ordering: Ordering, cleanup: bool = False, strict_empty: bool = False) -> None:
    """All records of the files in order, in one file; the files are read by one scan, and deleted afterwards with cleanup."""
    with reading(spark, sources, spec, cleanup) as df:
        df = df.drop("pos")
        write_records(merge([df], ordering.over(df), strict_empty=strict_empty), target, spec, single="true")


def check_file(spark: SparkSession, path: str, spec: RecordSpec, ordering: Ordering, source: str | None = None) -> bool:
    """Whether a file is in order and, with a source, has the same records."""
    df = read_records(spark, path, spec)
    for v in first_violations(df, ordering, "pos", shown=spec.shown()).collect():
        log.error("Out of order: index %d, previous %s, current %s", v["idx"], v["prev"], v["cur"])
    report = check(df, ordering, "pos").first()
    log.log(IMPORTANT, "%s", report.asDict())
    return bool(report["sorted"]) and (source is None or same_rows(read_records(spark, source, spec).drop("pos"), df.drop("pos")))


def sort_file(spark: SparkSession, source: str, target: str, spec: RecordSpec, ordering: Ordering, strict_empty: bool = False) -> None:
    """A file's records in order, in another file."""
    df = read_records(spark, source, spec).drop("pos")
    write_records(sort(df, ordering.over(df), strict_empty), target, spec, single="true")


if __name__ == "__main__":
    sys.exit(main())
