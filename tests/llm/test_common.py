import gc
import re
import time
from pathlib import Path

from siltstone.llm.common import tidy, trim


def anonymous_mb(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_tidy_gives_back_what_the_jvm_has_freed_outside_the_heap(spark):
    assert trim(spark)
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    tidy(spark)
    before = anonymous_mb(pid)
    buffers = [spark._jvm.java.nio.ByteBuffer.allocateDirect(50_000) for _ in range(3000)]
    assert anonymous_mb(pid) > before + 100
    buffers = buffers[::60]  # the rest is free, but the C library does not give it back by itself
    for _ in range(3):
        gc.collect()
        tidy(spark)
        time.sleep(0.5)
    assert anonymous_mb(pid) < before + 50, len(buffers)
