import os
import tempfile
from datetime import datetime

import pytest

from flockmetrics import Clock, SocialTables
from flockmetrics.session import session

AS_OF = datetime(2024, 1, 31)

SCHEMAS = {
    "casts": (
        "hash long, fid long, parent_hash long, root_parent_hash long, parent_url string, "
        "root_parent_url string, text string, created_at timestamp_ntz, deleted_at timestamp_ntz"
    ),
    "reactions": (
        "fid long, target_fid long, target_hash long, reaction_type int, "
        "created_at timestamp_ntz, deleted_at timestamp_ntz"
    ),
    "links": "fid long, target_fid long, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "fids": "fid long, custody_address binary, created_at timestamp_ntz",
    "verifications": "fid long, claim string",
    "profiles": "fid long, fname string",
    "early_channels": "channel_id string, parent_url string",
    "wallet_activity": (
        "wallet binary, txs long, nft_volume_usd double, dex_volume_usd double, contracts_deployed long, "
        "erc20_addresses array<binary>, nft_addresses array<binary>"
    ),
    "stopwords": "stopwords string",
}
DEFAULTS = {"created_at": datetime(2024, 1, 30)}


@pytest.fixture(scope="session")
def spark():
    return session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="warehouse-"),
    )


@pytest.fixture(scope="session")
def clock():
    return Clock(AS_OF)


@pytest.fixture(scope="session")
def table(spark):
    """Rows given as dicts; missing columns are NULL, ``created_at`` is the day before ``AS_OF``."""

    def build(name, rows=()):
        columns = [part.split()[0] for part in SCHEMAS[name].split(", ")]
        full = [tuple(row.get(c, DEFAULTS.get(c)) for c in columns) for row in rows]
        return spark.createDataFrame(full, SCHEMAS[name])

    return build


@pytest.fixture(scope="session")
def tables(table):
    def build(**rows):
        return SocialTables(**{name: table(name, rows.get(name, ())) for name in SCHEMAS})

    return build


@pytest.fixture(scope="session")
def smoke_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
