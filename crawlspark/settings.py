"""Job parameters that change what is computed."""

from dataclasses import dataclass

# Revisit profiles named by the WARC standard, per version.
REVISIT_PROFILES = {
    "1.0": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
    "1.1": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
}


@dataclass(frozen=True)
class ArchiveSettings:
    """Parameters of one archive run.

    ``pool_size`` is the number of files written side by side per file group;
    ``salts`` spreads the records of one hot payload over that many tasks;
    ``time_zone`` is the zone the calendar buckets follow and ``clock`` the
    timestamp column they are taken from, the fetch time or that of ingestion.
    ``order`` names a column of the records' arrival order, if request ids do
    not grow with time. A new dedup index gets ``index_buckets`` hash ranges, which should
    come to about a gigabyte each at the size that is expected.
    """

    warc_version: str = "1.1"
    host: str = "host0"
    pool_size: int = 1
    strict: bool = False
    time_zone: str = "UTC"
    salts: int = 256
    clock: str = "fetch_ts"
    order: str | None = None
    index_buckets: int = 16

    def __post_init__(self):
        if self.warc_version not in REVISIT_PROFILES:
            raise ValueError(f"unsupported WARC version: {self.warc_version}")
        if self.pool_size < 1 or self.salts < 1:
            raise ValueError("pool_size and salts must be at least 1")

    @property
    def revisit_profile(self) -> str:
        return REVISIT_PROFILES[self.warc_version]
