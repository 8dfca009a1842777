"""A Python data source for the live profile API: one partition per user name, one row per user that exists.

Options: logins (a JSON list), base_url, timeout (seconds). A user who cannot be read gives no row;
repositories that cannot be read count as none. Only the first page of 100 repositories is read.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold.session import ship


class _Login(InputPartition):
    def __init__(self, login: str):
        self.login = login


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.logins = json.loads(options.get("logins", "[]"))
        self.base = options.get("base_url", "https://api.github.com").rstrip("/")
        self.timeout = float(options.get("timeout", "15"))

    def partitions(self) -> list[InputPartition]:
        return [_Login(x) for x in self.logins]

    def _get(self, path: str) -> str | None:
        request = urllib.request.Request(self.base + path, headers={"Accept": "application/json", "User-Agent": "kinfold"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError, OSError):
            return None

    def read(self, partition: _Login) -> Iterator[tuple]:
        name = urllib.parse.quote(partition.login, safe="")
        user = self._get(f"/users/{name}")
        if user is not None:
            yield (partition.login, user, self._get(f"/users/{name}/repos?per_page=100&sort=updated") or "[]")


class ProfileApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kinfold_profiles"

    def schema(self) -> str:
        return "login string, user string, repos string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_profiles(spark: SparkSession, logins: list[str], **options: str) -> DataFrame:
    """(login, user, repos): JSON texts for each user name or profile address."""
    ship(spark)
    spark.dataSource.register(ProfileApi)
    names = [x.strip().rstrip("/").rsplit("/", 1)[-1].lstrip("@") for x in logins]
    base = spark.conf.get("kinfold.profile_api", None)
    options = ({"base_url": base} if base else {}) | options
    return spark.read.format("kinfold_profiles").options(logins=json.dumps(names), **options).load()
