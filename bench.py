"""Seconds per headline query; one JSON line.

Each query is built and collected into a no-op sink three times after one warm-up, and the median
counts. Derived tables and the results that others build on are stored beforehand, as they would
be at rest; their cost is listed under ``setup``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flockmetrics.operators.rollups import engaged_casts  # noqa: E402
from flockmetrics.plans.channels import channels_mart  # noqa: E402
from flockmetrics.plans.trending import ChannelFilters, UserFilters  # noqa: E402
from flockmetrics.plans.users import users_mart  # noqa: E402
from flockmetrics.session import session  # noqa: E402
from workload.queries import NFT, TOKEN, TOPIC, TRACKED  # noqa: E402
from workload.sample_tables import SAMPLE_SETTINGS, sample_book, sample_tables  # noqa: E402

RUNS = 3


def timed(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    setup = {"derived_tables": timed(lambda: sample_tables(spark, sf_dir).derive())}
    book = sample_book(spark, sf_dir)
    for name in ("engaged", "linked", "addresses", "members", "stored_users", "stored_channels"):
        setup[name] = timed(lambda: getattr(book, name))

    tables, clock = book.tables, book.clock
    tracked = UserFilters(10_000, channel=TOPIC, tracked_user=TRACKED, held_token=TOKEN, sort_by="engagement")
    queries = {
        # From the base tables; addresses and the users mart under the channels mart are stored.
        "engaged_casts": lambda: engaged_casts(tables.casts, tables.reactions, clock),
        "users_mart": lambda: users_mart(tables, clock, SAMPLE_SETTINGS, addresses=book.addresses),
        "channels_mart": lambda: channels_mart(tables, clock, book.stored_users, SAMPLE_SETTINGS),
        # On top of stored results.
        "users_by_tier": book.users_by_tier,
        "channels_by_tier": book.channels_by_tier,
        "trending_words": book.trending_words,
        "trending_users": lambda: book.trending_users(tracked),
        "trending_channels": lambda: book.trending_channels(ChannelFilters(10_000, TRACKED, NFT)),
    }
    seconds, cold = {}, {}
    for name, build in queries.items():
        def run() -> None:
            build().write.format("noop").mode("overwrite").save()

        # The first run compiles the query's code, and reads what the system has not read yet.
        cold[name] = round(timed(run), 3)
        seconds[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries, median of three runs each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
        "cpus": int(cpus),
        "cold": cold,
        "setup": {name: round(value, 3) for name, value in setup.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
