"""All pairs of the rows of a matrix, a slice of rows a task.

The matrix (n x p) is on the driver and broadcast. Nothing n x n is ever whole anywhere: tasks work on chunks of
their slice against all rows, and give back numbers a row.
"""

from __future__ import annotations

import hmac
import secrets
import socket
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Cells of a chunk: rows of a slice times all rows, near what a core's cache takes.
CELLS = 1 << 18
#: Rows of a block whose pairs give one tree.
TREE_ROWS = 2048


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by products; where these lose digits, by differences, so that equal rows are 0 apart."""
    nq, nx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    d = (-2 * q) @ x.T
    d += nq
    d += nx
    r, c = np.divmod(np.flatnonzero(d < 1e-4 * (nq + nx.max(initial=0))), len(x) or 1)
    lost = d[r, c] < 1e-4 * (nq[r, 0] + nx[0, c])
    r, c = r[lost], c[lost]
    for at in range(0, len(r), 1 << 16):
        i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
        d[i, j] = ((q[i] - x[j]) ** 2).sum(1)
    return d


class Kept:
    """Numbers in a file of the task, which ends with it: memory stays that of a chunk."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile(buffering=0)

    def put(self, at: int, v: np.ndarray) -> None:
        self.file.seek(8 * at)
        left = memoryview(v).cast("B")
        while left:
            left = left[self.file.write(left) :]

    def get(self, at: int, out: np.ndarray) -> np.ndarray:
        self.file.seek(8 * at)
        left = memoryview(out).cast("B")
        while left:
            got = self.file.readinto(left)
            if not got:
                raise EOFError
            left = left[got:]
        return out


def slots(spark: SparkSession) -> int:
    """Tasks that run side by side."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _read(of: socket.socket, size: int) -> bytes:
    out = bytearray()
    while len(out) < size:
        got = of.recv(min(size - len(out), 1 << 20))
        if not got:
            raise ConnectionError("a task of the barrier has ended")
        out += got
    return bytes(out)


class Exchange:
    """Called with an array by every task of a barrier, it gives each of them the arrays of all, by their number.

    They go through the first task's socket, as the barrier's own messages take a second; the barrier tells where that is.
    """

    def __init__(self) -> None:
        context = BarrierTaskContext.get()
        first, tasks = context.partitionId() == 0, context.getTaskInfos()
        listener = socket.create_server(("", 0)) if first else None
        port, word = context.allGather(f"{listener.getsockname()[1]} {secrets.token_hex(32)}" if first else "")[0].split()
        self.others: list[socket.socket] = []
        self.to: socket.socket | None = None
        if not first:
            self.to = socket.create_connection((tasks[0].address.rsplit(":", 1)[0], int(port)))
            self.to.sendall(word.encode() + context.partitionId().to_bytes(8, "little"))
        else:
            known: dict[int, socket.socket] = {}
            while len(known) < len(tasks) - 1:
                other = listener.accept()[0]
                other.settimeout(60)
                try:
                    if hmac.compare_digest(_read(other, len(word)), word.encode()):
                        known[int.from_bytes(_read(other, 8), "little")] = other
                except OSError:
                    continue
            self.others = [known[k] for k in sorted(known)]
            listener.close()
        for s in self.others if first else [self.to]:
            s.settimeout(None)
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, v: np.ndarray) -> list[np.ndarray]:
        own = np.ascontiguousarray(v, np.float64).tobytes()
        if self.to:
            self.to.sendall(len(own).to_bytes(8, "little") + own)
            sizes = np.frombuffer(_read(self.to, 8 * int.from_bytes(_read(self.to, 8), "little")), np.int64)
            return [np.frombuffer(_read(self.to, size), np.float64) for size in sizes.tolist()]
        parts = [own, *(_read(s, int.from_bytes(_read(s, 8), "little")) for s in self.others)]
        said = len(parts).to_bytes(8, "little") + np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)
        for s in self.others:
            s.sendall(said)
        return [np.frombuffer(p, np.float64) for p in parts]

    def close(self) -> None:
        for s in [self.to] if self.to else self.others:
            s.close()


class Slices:
    """``x`` with the tasks of a session."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        self.spark, self.x, self.n = spark, x, len(x)
        self.sent = spark.sparkContext.broadcast(x)

    def __enter__(self) -> Slices:
        return self

    def __exit__(self, *_: object) -> None:
        self.sent.unpersist()

    def _tasks(self, count: int, work: Callable[[np.ndarray, int], np.ndarray], barrier: bool = False) -> list[np.ndarray]:
        """``work(x, k)`` for k below ``count``, each in a task of its own; with ``barrier``, all of them at once."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    out = np.ascontiguousarray(work(sent.value, k), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([list(out.shape)], pa.list_(pa.int64())), pa.array([out.tobytes()], pa.large_binary()).cast(pa.binary())], ["k", "shape", "v"])

        rows = self.spark.range(0, count, 1, count).mapInArrow(run, "k long, shape array<long>, v binary", barrier=barrier).toArrow().sort_by("k")
        return [np.frombuffer(v.as_buffer(), np.float64).reshape(s.as_py()) for v, s in zip(rows["v"], rows["shape"])]

    def each(self, kernel: Callable[..., np.ndarray], *state: np.ndarray) -> np.ndarray:
        """``kernel(x, a, b, *state)``, an array of b - a rows, of all rows."""
        n, count = self.n, min(self.n, 2 * self.spark.sparkContext.defaultParallelism)
        ends, step = np.linspace(0, n, count + 1).astype(int), max(16, CELLS // n)

        def work(x: np.ndarray, k: int) -> np.ndarray:
            return np.concatenate([kernel(x, a, min(a + step, ends[k + 1]), *state) for a in range(ends[k], ends[k + 1], step)])

        return np.concatenate(self._tasks(count, work))

    def together(self, work: Callable[[np.ndarray, int, int, Callable[[np.ndarray], list[np.ndarray]]], np.ndarray]) -> list[np.ndarray]:
        """``work(x, a, b, exchange)`` of slices a to b, all at once: ``exchange(v)`` gives each the arrays of all, by slice."""
        count = min(self.n, slots(self.spark))
        ends = np.linspace(0, self.n, count + 1).astype(int).tolist()

        def run(x: np.ndarray, k: int) -> np.ndarray:
            exchange = Exchange()
            try:
                return work(x, ends[k], ends[k + 1], exchange)
            finally:
                exchange.close()

        return self._tasks(count, run, barrier=True)

    def nearest(self, k: int, metric: object = "euclidean") -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest of each row, itself first; equal distances by row."""
        from .neighbors import distances

        def kernel(x: np.ndarray, a: int, b: int) -> np.ndarray:
            d, i = distances(x[a:b], x, metric), np.arange(b - a)
            d[i, a + i] = -np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            d[i, a + i] = 0
            return np.stack([near, np.take_along_axis(d, near, 1)], 1)

        out = self.each(kernel)
        return out[:, 0].astype(np.int64), out[:, 1]

    def core(self, k: int) -> np.ndarray:
        """Distance to the k-th nearest row, the row itself counted."""

        def kernel(x: np.ndarray, a: int, b: int) -> np.ndarray:
            return np.sqrt(np.partition(squares(x[a:b], x), k - 1, axis=1)[:, k - 1])

        return self.each(kernel)

    def spanning_tree(self, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, length) of a minimal spanning tree; with ``core``, of max(distance, core of a, core of b).

        An edge of it is one of the tree of any two blocks that hold its ends, so trees of pairs of blocks have it.
        """
        blocks = np.array_split(np.arange(self.n), max(1, -(-self.n // TREE_ROWS)))
        pairs = [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks))] or [(0, 0)]

        def work(x: np.ndarray, k: int) -> np.ndarray:
            own = np.unique(np.concatenate([blocks[i] for i in pairs[k]]))
            a, b, length = tree(x[own], None if core is None else core[own])
            return np.stack([own[a], own[b], length], 1)

        a, b, length = np.concatenate(self._tasks(len(pairs), work)).T
        a, b = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        order = np.lexsort((b, a, length))
        up, keep = list(range(self.n)), []
        for e, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            while up[j] != j:
                up[j] = up[up[j]]
                j = up[j]
            if i != j:
                up[i] = j
                keep.append(e)
        return a[keep], b[keep], length[keep]


def tree(x: np.ndarray, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal spanning tree of the rows, grown from the first; memory for one row of distances."""
    n, v = len(x), 0
    best, source, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    ends, low = np.zeros((2, max(n - 1, 0)), np.int64), None if core is None else core * core
    norms = (x * x).sum(1)
    for step in range(n - 1):
        left[v] = False
        d = norms + norms[v] - 2 * (x @ x[v])
        near = np.flatnonzero(d < 1e-4 * (norms + norms[v]))
        d[near] = ((x[near] - x[v]) ** 2).sum(1)
        if low is not None:
            d = np.maximum(np.maximum(d, low), low[v])
        new = d < best
        best[new], source[new] = d[new], v
        v = int(np.argmin(np.where(left, best, np.inf)))
        ends[:, step] = source[v], v
    a, b = ends
    length = np.sqrt(((x[a] - x[b]) ** 2).sum(1))
    return a, b, length if core is None else np.maximum(length, np.maximum(core[a], core[b]))


def largest(multiply: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-10, seed: int = 0, blocks: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues of a symmetric operator, by a Krylov space of blocks that starts anew from its best vectors."""
    width = min(n, k + 8)
    new, basis, images = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0], np.zeros((n, 0)), np.zeros((n, 0))
    while True:
        basis, images = np.hstack([basis, new]), np.hstack([images, multiply(new)])
        t = basis.T @ images
        w, s = np.linalg.eigh((t + t.T) / 2)
        w, s = w[::-1], s[:, ::-1]
        vectors, moved = basis @ s[:, :width], images @ s[:, :width]
        rest = moved - vectors * w[:width]
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tol * np.abs(w).max() or basis.shape[1] >= n:
            return w[:k], vectors[:, :k]
        if basis.shape[1] >= blocks * width:
            basis, images = basis @ s[:, : 3 * width], images @ s[:, : 3 * width]
        new = rest[:, : n - basis.shape[1]]
        for _ in range(3):  # again after the first, as what is left may be tiny
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
