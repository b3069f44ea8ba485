"""Sinks that leave a whole result or none."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.functions.hashing import content_hash


def write_json(path: str, content: dict) -> None:
    """A file beside the target, then a rename."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w") as f:
        json.dump(content, f, indent=1, sort_keys=True, default=str)
    os.replace(beside, path)


def read_json(path: str, default: dict) -> dict:
    if not os.path.exists(path):
        return default
    with open(path) as f:
        return json.load(f)


def write_version(df: DataFrame, root: str, version: str, parts: list[Column], force: bool = False) -> str:
    """Writes the table under ``root/version`` unless the last one written has the same version and content; gives its path.

    ``root/current.json`` names the table in force and changes only after the data is complete.
    """
    total = content_hash(df, [], [F.lit(",".join(sorted(df.columns))), *parts]).first()
    digest = total["content_hash"]
    current = read_json(f"{root}/current.json", {})
    if not force and (current.get("version"), current.get("hash")) == (version, digest):
        return current["path"]
    path = f"{root}/{version}/{digest[:16]}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    write_json(f"{root}/current.json", {"version": version, "hash": digest, "rows": total["n_rows"], "path": path})
    return path


def write_run(root: str, config: dict, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """A run's tables, each partitioned as named, and last its configuration: a run without config.json is not complete."""
    for name, (df, by) in tables.items():
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}")
    write_json(f"{root}/config.json", config)


def latest_run(root: str) -> str | None:
    """The lexicographically last complete run."""
    runs = sorted(r for r in (os.listdir(root) if os.path.isdir(root) else []) if os.path.exists(f"{root}/{r}/config.json"))
    return f"{root}/{runs[-1]}" if runs else None


def write_report(path: str, sections: dict[str, DataFrame], most_rows: int = 10_000) -> dict:
    """A JSON report with the worst status of all rows; a section that cannot be made is reported as its error.

    ``rows`` has each section's number of rows. Of a section of more than ``most_rows`` the report shows that many, the worst
    first, and ``tables`` names the table beside the report that holds all of them.
    """
    rank = {"PASS": 0, "WARN": 1, "FAIL": 2}
    out: dict = {"sections": {}, "status": "PASS", "rows": {}, "tables": {}}
    for name, df in sections.items():
        try:
            worst = F.lit(0)
            if "status" in df.columns:
                worst = F.coalesce(*(F.when(F.col("status").cast("string") == s, k) for s, k in rank.items()), worst)
            all_rows = df.agg(F.count(F.lit(1)).alias("n"), F.max(worst).alias("worst")).first()
            out["status"] = max([out["status"], *(s for s, k in rank.items() if k == all_rows["worst"])], key=lambda s: rank[s])
            shown = df
            if all_rows["n"] > most_rows:
                table = f"{os.path.splitext(path)[0]}-{name}-{uuid.uuid4().hex[:8]}"
                df.write.parquet(table)
                plain = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
                shown = df.sparkSession.read.schema(df.schema).parquet(table).orderBy(worst.desc(), *plain).limit(most_rows)
                out["tables"][name] = table
            rows = [r.asDict(recursive=True) for r in shown.collect()]
        except Exception as e:  # noqa: BLE001 - a report is made as far as it can be
            out["sections"][name] = {"error": str(e)[:300]}
            continue
        out["sections"][name] = rows
        out["rows"][name] = all_rows["n"]
    write_json(path, out)
    return out
