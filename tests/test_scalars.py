import posixpath
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from samebytes.functions import common, cursors, hashes, numbers, paths, predicates, variants


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expression(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_paths_are_accepted_and_rejected(spark):
    cases = {
        "../evil.bin": "traversal",
        "nested/../../escape.bin": "traversal",
        "~/private.bin": "home",
        "$HOME/private.bin": "variable",
        "/absolute/path.bin": "absolute",
        "/absolute/../~$": "absolute",
        "a/..~": "home",
        "media/photo.jpg": None,
        "a/..b/c..": None,
        None: "missing",
    }
    got = column(spark, list(cases), "string", paths.safe_relative_path)
    assert [r.reason for r in got] == list(cases.values())
    assert [r.ok for r in got] == [v is None for v in cases.values()]


def test_lexical_normalisation(spark):
    cases = {
        "/a/b": "/a/b",
        "/a/./b/": "/a/b",
        "/a//b/../c": "/a/c",
        "/../../x": "/x",
        "/a/..": "/",
        "/": "/",
        "/a/...": "/a/...",
    }
    assert column(spark, list(cases), "string", paths.normalize_lexically) == list(cases.values())


def test_random_paths_agree_with_the_standard_library(spark):
    rng = random.Random(3)
    parts = ["a", "b.Jpg", "..", ".", "", "c.tar.gz", ".hid", "x.", "é.MP4", "..."]
    made = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(600)]
    absolute = ["/" + path for path in made]
    normal = column(spark, absolute, "string", paths.normalize_lexically)
    assert normal == ["/" + posixpath.normpath(path).lstrip("/") for path in absolute]
    safe = column(spark, made, "string", paths.safe_relative_path)
    assert [r.ok for r in safe] == [not p.startswith("/") and ".." not in PurePosixPath(p).parts for p in made]
    named = [p for p in made if PurePosixPath(p).name not in ("", "..", "...")]
    assert column(spark, named, "string", paths.suffix) == [PurePosixPath(p).suffix.lower() for p in named]


def test_random_group_keys_are_read_the_same_way_everywhere(spark):
    rng = random.Random(4)
    made = []
    for _ in range(300):
        digest = "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice([64, 64, 64, 62, 65])))
        if rng.random() < 0.2:
            digest = digest[:-1] + rng.choice("gz :")
        made.append(rng.choice(["sha256:", "BLAKE3:", " sha256:", "md5:", "sha256", ""]) + digest + rng.choice(["", " ", "\n"]))
    for key, row in zip(made, column(spark, made, "string", hashes.parse_group_key)):
        try:
            algorithm, digest = hashes.read_group_key(key)
        except ValueError:
            assert not row.ok, key
        else:
            assert row.ok and (row.algorithm, bytes(row.content_hash)) == (algorithm, digest), key


def test_clock_before_1970(spark):
    df = spark.range(1).select(F.unix_micros(common.as_timestamp("1969-12-31 23:59:59.500000")))
    assert df.first()[0] == -500_000


def test_containment_is_by_component(spark):
    cases = {
        "/libraries": True,
        "/libraries/x": True,
        "/libraries2/x": False,
        "/libraries/x/../../etc": False,
        "/tmp/escape": False,
        "/libraries/..": False,
    }
    got = column(spark, list(cases), "string", lambda v: paths.contained_under(F.lit("/libraries"), v))
    assert got == list(cases.values())
    assert column(spark, ["/x"], "string", lambda v: paths.contained_under(F.lit("/"), v)) == [True]


def test_library_names(spark):
    cases = {" media\t": "media", " x": "x", "": None, " ": None, ".": None, "..": None, "a/b": None, "a\\b": None, "~a": None, "a$": None}
    got = column(spark, list(cases), "string", paths.library_name)
    assert [r.name if r.ok else None for r in got] == list(cases.values())


def test_media_types(spark):
    cases = {
        "a/b.JPG": "image", "b.webp": "image", "c.Mp4": "video", "x.mkv": "video", "d.txt": None,
        ".jpg": None, "x.": None, "x": None, "dir.jpg/x": None, "a.tar.png": "image", "a.jpg/": "image", "..jpg": "image",
    }
    assert column(spark, list(cases), "string", paths.media_type) == list(cases.values())


def test_posix_paths(spark):
    cases = {"a//b/./c": "a/b/c", "./x": "x", "": None, ".": None, "a/../b": None}
    assert column(spark, list(cases), "string", paths.posix_path) == list(cases.values())


def test_long_errors_are_cut(spark):
    text = "at /data/real/x: " + "é" * 2000
    got = column(spark, [text, "short"], "string", lambda v: paths.sanitize_error(v, {"/data/real": "/libraries", "": "no"}, 50))
    assert got[0] == ("at /libraries/x: " + "é" * 2000)[:50] + "...(truncated)"
    assert got[1] == "short"


def test_bytes_as_text(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1 KiB", 1536: "2 KiB", 1024**2: "1.0 MiB", 1310720: "1.3 MiB", 5 * 1024**3 // 4: "1.3 GiB", 1024**4: "1.0 TiB", 3000 * 1024**4: "3000.0 TiB"}
    assert column(spark, list(cases), "long", numbers.format_bytes) == list(cases.values())


def test_retry_delays(spark):
    got = column(spark, [0, 1, 2, 3, 8, 11, 12, 99], "int", lambda v: numbers.retry_delay_seconds(v, 30, 3600))
    assert got == [30, 30, 60, 120, 3600, 3600, 3600, 3600]
    assert column(spark, [99], "int", lambda v: numbers.retry_delay_seconds(v, 1, 10**9)) == [1024]


def test_io_budget_does_not_overflow(spark):
    got = column(spark, [0, 1, 1048576, 1048577, 2**62], "long", lambda v: numbers.io_budget_ms(v, 1))
    assert got == [0, 1, 1000, 1001, -(-(2**62) * 1000 // 1048576)]


def test_payload_options(spark):
    texts = ['{"n":5}', '{"n":-5}', '{"n":5.0}', '{"n":"5"}', '{"n":null}', "{}", "not json", '{"n":0}']
    assert column(spark, texts, "string", lambda v: numbers.payload_uint(v, "n")) == [5, None, None, None, None, None, None, 0]
    texts = ['{"n":"a b"}', '{"n":5}', '{"n":null}', '{"n":["a"]}', '{"n":""}']
    assert column(spark, texts, "string", lambda v: numbers.payload_string(v, "n")) == ["a b", None, None, None, ""]
    texts = ['{"n":["a","b"]}', '{"n":[]}', '{"n":null}', "{}", '{"n":"a"}', '{"n":["a",1]}', '{"n":["a",null]}', '{"n":[["a"]]}']
    got = column(spark, texts, "string", lambda v: numbers.payload_string_list(v, "n"))
    assert [tuple(r) for r in got] == [
        (["a", "b"], None), ([], None), (None, None), (None, None), (None, "not_an_array"),
        (None, "not_strings"), (None, "not_strings"), (None, "not_strings"),
    ]


def test_group_key_round_trip(spark):
    digest = bytes(range(32))
    key = column(spark, [digest, None], "binary", lambda v: hashes.group_key(F.lit("blake3"), v))
    assert key == [f"blake3:{digest.hex()}", None]
    parsed = column(spark, key[:1], "string", hashes.parse_group_key)[0]
    assert (parsed.algorithm, bytes(parsed.content_hash), parsed.ok) == ("blake3", digest, True)
    assert hashes.read_group_key(f" BLAKE3:{digest.hex().upper()}\n") == ("blake3", digest)


def test_cursors_on_columns_equal_cursors_of_requests(spark):
    cursor = cursors.GroupCursor(12, 3456, "sha256", "0f" * 32)
    token = cursors.encode_group_cursor(cursor)
    df = spark.createDataFrame([tuple(cursor)], "file_count long, total_size_bytes long, hash_algorithm string, content_hash_hex string")
    assert df.select(cursors.group_cursor(*cursor._fields)).first()[0] == token
    got = column(spark, [token, token[:-3], "%%%", "", None], "string", cursors.parse_group_cursor)
    assert [r and tuple(r) for r in got] == [tuple(cursor), None, None, None, None]


def test_formats_and_dimensions(spark):
    assert column(spark, [None, " WEBP ", "jpeg", "png", ""], "string", variants.variant_format) == ["jpeg", "webp", "jpeg", None, None]
    assert column(spark, [None, 1, 256, 257, 0, -1], "int", variants.variant_dimension) == [256, 1, 256, None, None, None]
    assert column(spark, [-1, 0, 15, 16, 200, 999], "int", variants.execution_dimension) == [256, 16, 16, 16, 200, 256]


@pytest.mark.parametrize(
    "message,code",
    [
        ("FFMPEG failed on path", "THUMB_VIDEO_FFMPEG_FAILED"),
        ("Path has bad format", "THUMB_PATH_POLICY_REJECTED"),
        ("cannot Decode", "THUMB_DECODE_FAILED"),
        ("boom", "THUMB_GENERATION_FAILED"),
    ],
)
def test_error_codes(spark, message, code):
    assert column(spark, [message], "string", variants.classify_error) == [code]


def test_blank_defaults(spark):
    got = column(spark, [None, "", "  ", "x "], "string", lambda v: common.default_if_blank(v, "D"))
    assert got == ["D", "D", "D", "x "]


def test_times_without_zone_are_utc_in_any_session(spark, settings):
    with settings(spark__sql__session__timeZone="America/New_York"):
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-16 00:00:00' AS t")
        assert df.select(F.unix_micros(common.utc("t"))).first()[0] == 1705363200000000


def test_digest_algorithm_names(spark):
    got = column(spark, ["sha256", " BLAKE3", "md5", None], "string", hashes.digest_algorithm)
    assert got == ["sha256", "blake3", None, None]


def test_rejects_name_their_columns(spark):
    df = spark.createDataFrame([(1, "scan", "pending"), (2, "SCAN", "x"), (3, None, "failed")], "id int, kind string, status string")
    enums = {"kind": ("scan", "hash"), "status": ("pending", "failed")}
    good, bad = predicates.split_rejects(df, enums)
    assert [r.id for r in good.collect()] == [1]
    assert sorted((r.id, r.invalid) for r in bad.collect()) == [(2, "kind,status"), (3, "kind")]
    good, _ = predicates.split_rejects(df, enums, nullable=["kind"])
    assert sorted(r.id for r in good.collect()) == [1, 3]
