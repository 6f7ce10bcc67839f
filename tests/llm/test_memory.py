"""What a Python worker of an executor holds."""

import subprocess
import sys

#: Peak MB beside what the process had when the encoder was loaded, over texts of ever new words.
MEASURE = """
import resource, random
import pyarrow as pa
from quotemill.llm.shared import slices
from quotemill.llm.tokenization import TEXT_BYTES, default_vocabulary, encoder

encode, rng = encoder(default_vocabulary()).encode, random.Random(3)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in range(8):
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.getrandbits(32):x}" for _ in range(230)) for _ in range(1500)]
    for part in slices(iter([pa.RecordBatch.from_pydict({"text": texts})]), limit=TEXT_BYTES):
        encode(part.column("text"))
print(before / 1024, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_an_encoder_stays_small():
    loaded, grown = map(float, subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True).stdout.split())
    assert loaded < 140 and grown < 300, (loaded, grown)
