"""Settings: of jobs (E6) and of scoring sessions (S14, E11), with the checks that reject them before any work."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from datetime import datetime

# Run modes, and names of matrix kernels that settings files may give.
MODES = ("coordinator", "worker", "local", "cluster")
KERNELS = ("naive", "reordered", "tiled", "packed", "auto")


@dataclass
class JobConfig:
    """A job's settings; their names, defaults and least values are fixed values. Sizes and timeouts that Spark governs by itself are checked and passed on as Spark settings."""

    input_dir: str = ""
    root: str = "work"
    job_name: str = "mapreduce"
    job_id: str = ""
    mode: str = "local"
    num_mappers: int = 4
    num_reducers: int = 2
    workers: int = 8
    address: str = "127.0.0.1:5330"
    spill_bytes: int = 32 << 20
    task_timeout_s: float = 30.0
    worker_timeout_s: float = 5.0
    heartbeat_s: float = 1.0
    backup_tasks: bool = True
    backup_threshold: float = 1.5
    max_attempts: int = 4

    def validate(self) -> None:
        """Whether ``input_dir`` is there is told by the reader of files, which knows any store; a local path that is a file is refused here."""
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode != "worker":
            if not self.input_dir:
                raise ValueError("input_dir is required")
            if os.path.isfile(self.input_dir):
                raise ValueError(f"input_dir {self.input_dir!r} is no folder")
            for name in ("num_mappers", "num_reducers"):
                if getattr(self, name) < 1:
                    raise ValueError(f"{name} must be at least 1")
        for name, least in (("spill_bytes", 1024), ("workers", 1), ("backup_threshold", 1), ("max_attempts", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.task_timeout_s <= 0 or self.worker_timeout_s <= self.heartbeat_s:
            raise ValueError("timeouts must be positive and longer than a heartbeat")

    def resolve_job_id(self, now: datetime | None = None) -> str:
        """F-joblabel: the given id, or the name with the time."""
        self.job_id = self.job_id or f"{self.job_name}-{now or datetime.now():%Y-%m-%d-%H-%M-%S}"
        return self.job_id

    def master(self) -> str:
        """threads of this process, or processes of this machine; other modes name a cluster by its address."""
        if self.mode == "local":
            return f"local[{self.workers},{self.max_attempts}]"
        return f"local-cluster[{self.workers},1,1024]" if self.mode == "cluster" else f"spark://{self.address}"

    def spark_conf(self) -> dict[str, str]:
        """liveness, backup tasks and attempts, as Spark's settings."""
        return {
            "spark.app.name": self.job_name,
            "spark.sql.shuffle.partitions": str(self.num_reducers),
            "spark.speculation": str(self.backup_tasks).lower(),
            "spark.speculation.multiplier": str(self.backup_threshold),
            "spark.speculation.quantile": "0.5",
            "spark.task.maxFailures": str(self.max_attempts),
            "spark.executor.heartbeatInterval": f"{int(self.heartbeat_s * 1000)}ms",
            "spark.network.timeout": f"{max(int(self.worker_timeout_s * 1000), 10_000)}ms",
            # Spark has no time limit of a task; one that is killed as a backup's loser, or with its job, is made to end after this long
            "spark.task.reaper.enabled": "true",
            "spark.task.reaper.killTimeout": f"{max(int(self.task_timeout_s * 1000), 1)}ms",
        }


def parse_bool(value: str, key: str = "") -> bool:
    if value in ("true", "1", "yes"):
        return True
    if value in ("false", "0", "no"):
        return False
    raise ValueError(f"{key} is {value!r}, which is neither true nor false")


def parse_size(value: str, key: str = "") -> int:
    """A non-negative number; like the C library, what follows its digits is not read."""
    found = re.match(r"\s*\+?(\d+)", value)
    if not found or int(found[1]) > 2**63 - 1:
        raise ValueError(f"{key} is {value!r}, which is no whole number from 0 on")
    return int(found[1])


@dataclass
class SessionConfig:
    """A scoring session's settings; their names, defaults and ranges are fixed values. Threads, pool and address are accepted and checked; Spark has its own."""

    name: str = "session"
    model_path: str = ""
    execution_provider: str = "cpu"
    gemm_strategy: str = "auto"
    max_batch_size: int = 128
    intra_op_threads: int = 1
    inter_op_parallel: bool = False
    graph_optimization: bool = True
    memory_pool: bool = True
    profiling: bool = False
    max_queue_delay_microseconds: int = 2000
    http_address: str = "127.0.0.1"
    http_port: int = 8080

    def validate(self) -> None:
        if not self.model_path:
            raise ValueError("there is no model_path")
        for name, most in (("max_batch_size", 4096), ("intra_op_threads", 256), ("http_port", 65535)):
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between 1 and {most}")
        if self.gemm_strategy not in KERNELS:
            raise ValueError(f"gemm_strategy is {self.gemm_strategy!r} and not one of {', '.join(KERNELS)}")
        if self.execution_provider != "cpu":
            raise ValueError(f"execution_provider is {self.execution_provider!r}; there is cpu only")

    @classmethod
    def parse(cls, text: str) -> SessionConfig:
        """``key: value`` lines, ``#`` comments, values in double quotes or not. Unknown keys raise."""
        config, kinds = cls(), {f.name: f.type for f in fields(cls)}
        for number, line in enumerate(text.split("\n"), 1):
            line = line.partition("#")[0].strip(" \t\r\n")
            if not line:
                continue
            key, colon, value = line.partition(":")
            key, value = key.strip(" \t\r\n"), value.strip(" \t\r\n")
            if not colon:
                raise ValueError(f"line {number} has no colon: {line}")
            if len(value) >= 2 and value[0] == value[-1] == '"':
                value = value[1:-1]
            if key not in kinds:
                raise ValueError(f"unknown key {key!r} in line {number}")
            setattr(config, key, parse_bool(value, key) if kinds[key] == "bool" else parse_size(value, key) if kinds[key] == "int" else value)
        config.validate()
        return config

    @classmethod
    def from_file(cls, path: str) -> SessionConfig:
        with open(path) as file:
            return cls.parse(file.read())

    def to_text(self) -> str:
        shown = lambda v: str(v).lower() if isinstance(v, bool) else v
        return "".join(f"{f.name}: {shown(getattr(self, f.name))}\n" for f in fields(self))
