"""Claims on a shared store: of many sessions that want the same result, one makes it and the others wait for it.

A claim is a file that exists or doesn't; making it is create-if-absent, which the store must give atomically (HDFS
does, and so do object stores with conditional writes). The file names its owner, and the owner renews it while
it works, so that a claim which was not renewed for a lease belongs to a session that is gone: whoever moves it away by an
atomic rename may then claim anew.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Small files of a folder in any file system that Spark reads.

    Hadoop's local file system looks first and creates afterwards, so local files are made by the system's own exclusive
    create; other stores by ``create`` without overwriting.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._local = self._fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _path(self, name: str) -> Path:
        return Path(self._at(name).toUri().getPath())

    def _missing_is(self, default, act: Callable):
        """``act()``, or ``default`` where the file isn't there."""
        try:
            return act()
        except FileNotFoundError:
            return default
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return default
            raise

    def create(self, name: str, text: str = "") -> bool:
        """Whether this call made the file; False if it was there."""
        if self._local:
            self._path(name).parent.mkdir(parents=True, exist_ok=True)
            try:
                with self._path(name).open("x") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        """The file's text; None if there is none."""

        def act() -> str:
            if self._local:
                return self._path(name).read_text()
            stream = self._fs.open(self._at(name))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()

        return self._missing_is(None, act)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def age(self, name: str) -> float | None:
        """Seconds since the file was last renewed, by this machine's clock; None if there is none."""
        return self._missing_is(None, lambda: time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000)

    def renew(self, name: str) -> None:
        self._missing_is(None, lambda: self._fs.setTimes(self._at(name), int(time.time() * 1000), -1))

    def move(self, old: str, new: str) -> bool:
        """An atomic rename to a name that nobody else has; False if another session was first."""
        if self._local:
            return self._missing_is(False, lambda: self._path(old).rename(self._path(new)) is not None)
        return self._missing_is(False, lambda: self._fs.rename(self._at(old), self._at(new)))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def names(self, name: str = "") -> list[str]:
        return self._missing_is([], lambda: sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))))


class Claims:
    """Claims in ``store``, each held for ``lease`` seconds since it was last renewed; waiters look every ``poll``."""

    def __init__(self, store: Store, lease: float = 600.0, poll: float = 0.2):
        self.store, self.lease, self.poll = store, lease, poll
        self.owner = uuid.uuid4().hex

    def take(self, name: str) -> bool:
        """One attempt; a claim whose lease ran out is moved away first."""
        if self.store.create(name, self.owner):
            return True
        age = self.store.age(name)
        if age is not None and age > self.lease:
            gone = f"{name}.{uuid.uuid4().hex}.gone"
            if self.store.move(name, gone):
                self.store.delete(gone)
            return self.store.create(name, self.owner)
        return False

    def mine(self, name: str) -> bool:
        return self.store.read(name) == self.owner

    def release(self, name: str) -> None:
        if self.mine(name):
            self.store.delete(name)

    @contextmanager
    def held(self, name: str) -> Iterator[None]:
        """Keeps a claim that was taken alive while its owner works, and gives it back."""
        over = threading.Event()

        def renew() -> None:
            while not over.wait(self.lease / 4):
                self.store.renew(name)

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            over.set()
            keeper.join()
            self.release(name)
