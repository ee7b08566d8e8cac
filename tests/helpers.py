"""Comparison with DuckDB and small image files."""

import struct
import zlib

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def oracle(sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def rows_of(frame):
    def value(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def png(path, image):
    """An 8-bit PNG of a (height, width[, 3 or 4]) array."""
    h, w = image.shape[:2]
    kind = {2: 0, 3: 2 if image.shape[-1] == 3 else 6}[image.ndim]

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    raw = b"".join(b"\0" + row.tobytes() for row in image)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
