from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from rankloom.session import ship_package


def test_threads_ship_the_package_once():
    added = []

    def add(path):
        time.sleep(0.2)
        added.append(path)

    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app-of-this-test", addPyFile=add))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship_package, [spark] * 4))
    assert len(added) == 1
