"""Fetching registry releases and data bundles, on the driver and outside of queries.

    python -m orgweave.sources.fetch URL TARGET
"""

from __future__ import annotations

import json
import os
import sys
import time
import urllib.request
from collections.abc import Callable


class Lock:
    """A lock file that one process at a time can make; given up after `patience` seconds."""

    def __init__(self, path: str, patience: float = 600):
        self.path, self.patience = path, patience

    def __enter__(self) -> "Lock":
        began = time.monotonic()
        while True:
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL))
                return self
            except FileExistsError:
                if time.monotonic() - began > self.patience:
                    raise TimeoutError(f"{self.path} is held by another process") from None
                time.sleep(0.2)

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def download(url: str, target: str, open_url: Callable = urllib.request.urlopen) -> str:
    """Fetch a file once: under a lock, to a temporary name, moved in place when complete."""
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    if os.path.exists(target):
        return target
    with Lock(target + ".lock"):
        if not os.path.exists(target):  # another process may have been faster
            with open_url(url) as source, open(target + ".part", "wb") as out:
                while chunk := source.read(1 << 20):
                    out.write(chunk)
            os.replace(target + ".part", target)
    return target


def release_archive(api_url: str, open_url: Callable = urllib.request.urlopen) -> str:
    """The address of the first .zip file of a release record (`files: [{key, links: {self}}]`)."""
    with open_url(api_url) as source:
        record = json.load(source)
    for file in record.get("files", []):
        if str(file.get("key", "")).endswith(".zip"):
            return file["links"]["self"]
    raise FileNotFoundError(f"no .zip file in {api_url}")


if __name__ == "__main__":
    print(download(sys.argv[1], sys.argv[2]))
