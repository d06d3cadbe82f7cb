"""Scalar functions: their rules over generated names, and their edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions import numeric as N
from larder.functions import text as T
from larder.functions.register import register
from larder.sources import files as S


def each(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "vos", "zel", "bri"]


def made_words(seed, n, least=2, most=3):
    """Invented lower-case words that no list of the library holds."""
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(least, most))) for _ in range(n)]


def test_canonical_of_generated_names(spark):
    """However the words of a tag are joined, spaced or cased, it is their kebab case, and canonical forms stay as they are."""
    rng, names, want = random.Random(1), [], []
    for k in range(40):
        parts = made_words(k, rng.randint(1, 4))
        joint = rng.choice([" ", "_", "-", " - ", "__", ".", "/"])
        style = rng.choice(["camel", "upper", "spaced", "title"])
        text = {"camel": parts[0] + "".join(p.capitalize() for p in parts[1:]), "upper": joint.join(parts).upper(), "spaced": joint.join(parts), "title": joint.join(p.capitalize() for p in parts)}[style]
        names.append(" " * rng.randint(0, 2) + text + rng.choice(["", " ", "--", "!"]))
        want.append("-".join(parts))
    got = each(spark, T.canonical, names)
    assert got == want
    assert each(spark, T.canonical, got) == got


def test_canonical_digits_aliases_and_blanks(spark):
    word = made_words(7, 1)[0]
    assert each(spark, T.canonical, [f"{word}7Xu", f"7{word}", "", " - ", None]) == [f"{word}7xu", f"7{word}", "", "", None]
    keys = list(T.ALIASES)
    assert each(spark, T.canonical, [k.upper() for k in keys]) == list(T.ALIASES.values())


def test_resolve_by_namespace(spark):
    word = made_words(9, 1)[0]
    inputs = [f"{n}:{word.upper()}" for n in T.NAMESPACES] + [f"{word}:{word}", word, f"{T.NAMESPACES[0]}:  "] + [tags[0] for tags in T.VOCABULARY.values()]
    want = [(word, n) for n in T.NAMESPACES] + [(f"{word}-{word}", None), (word, None), (T.NAMESPACES[0], None)] + [(tags[0], n) for n, tags in T.VOCABULARY.items()]
    assert [tuple(x) for x in each(spark, T.resolve, inputs)] == want


def test_name_words_of_generated_names(spark):
    """Words come out in order and once; numbers, versions, single letters and noise do not."""
    rng, names, want = random.Random(2), [], []
    for k in range(30):
        parts = list(dict.fromkeys(made_words(100 + k, rng.randint(1, 4))))
        filler = rng.sample(["v12", "007", "q", *T.NOISE], 3)
        mixed = parts + [p + str(rng.randint(1, 99)) for p in parts[:1]]
        for x in filler:
            mixed.insert(rng.randint(0, len(mixed)), x)
        names.append("_".join(mixed) + ".ext")
        want.append(parts)
    assert each(spark, T.name_words, names) == want
    eight = made_words(5, 40)
    assert each(spark, T.title_tags, [" ".join(eight)]) == [list(dict.fromkeys(eight))[:6]]


def test_folders_of_generated_paths(spark):
    rng, rows, want = random.Random(3), [], []
    for k in range(20):
        folders = made_words(200 + k, rng.randint(0, 4))
        path = folders[:]
        path.insert(rng.randint(0, len(path)), rng.choice(T.NOISE_FOLDERS).upper())
        rows.append(("/mount/" + "/".join([*path, "file.ext"]), "/mount"))
        want.append(list(dict.fromkeys(reversed(folders)))[:3])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, r string")
    assert [r[0] for r in df.orderBy("i").select(T.folder_tags("p", "r", 3)).collect()] == want
    word = made_words(8, 1)[0]
    roots = [f"/{word}/{g}" for g in T.GENERIC_FOLDERS] + [f"/{g}/{word.capitalize()}" for g in T.GENERIC_FOLDERS] + ["/" + T.GENERIC_FOLDERS[0], "/"]
    assert each(spark, T.root_label, roots) == [word] * (2 * len(T.GENERIC_FOLDERS)) + [T.GENERIC_FOLDERS[0], "root"]


def test_quantity(spark):
    assert each(spark, N.quantity, ["512", "1mb", "2s", "250ms", "-6db", "192kbps", "192kb", "wide", "1 parsec", None]) == [512.0, 1048576.0, 2.0, 0.25, -6.0, 192000.0, 196608.0, None, None, None]


def test_urls_of_generated_parts(spark):
    """Scheme and host come out in lower case without the fragment, path and query as they are; a bare host gets https."""
    rng, raw, want, hosts, titles = random.Random(4), [], [], [], []
    for k in range(30):
        name, path = made_words(300 + k, 1)[0], made_words(400 + k, rng.randint(1, 3))
        scheme = rng.choice(["http", "https", None])
        host, port = f"{name}.example", rng.choice(["", ":8443"]) if scheme else ""
        www = rng.choice(["", "www."])
        tail = "/" + "/".join(path[:-1] + [path[-1] + rng.choice(["-", "_"]) + "Ab"]) + rng.choice(["", ".html"])
        query = rng.choice(["", "?Q=1"])
        shown = rng.choice([str.upper, str.lower])(www + host) + port
        raw.append((f"{scheme.upper()}://" if scheme else "") + shown + tail + query + rng.choice(["", "#part"]))
        want.append(f"{scheme or 'https'}://{www}{host}{port}{tail}{query}")
        hosts.append(host)
        titles.append(path[-1] + " Ab")
    got = each(spark, T.normalise_url, raw)
    assert got == want
    assert each(spark, T.host_of, got) == hosts
    assert each(spark, T.slug_title, got) == titles
    assert each(spark, T.slug_title, ["https://" + hosts[0]]) == [hosts[0]]


@pytest.mark.parametrize("text", ["ftp://kalo.example/a", "mailto:a@kalo.example", "kalo", "two words", "[1, 2]", "", " ", "https://", "http://-/x", None])
def test_no_addresses(spark, text):
    assert each(spark, T.normalise_url, [text]) == [None]


def test_safe_relative_never_leaves_its_folder(spark):
    """Whatever is strung together, no part is empty, a parent, hidden or a drive, and sound names stay."""
    rng = random.Random(5)
    parts = ["..", ".", "", "K:", ".dot", "...", "mi", "lo.x", "a b"]
    names = [rng.choice(["", "/", "\\", "Q:/", "//"]) + rng.choice("/\\").join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(200)]
    for name, out in zip(names, each(spark, T.safe_relative, names), strict=True):
        assert out and not out.startswith("/") and "\\" not in out, name
        assert all(p and p not in (".", "..") and not p.startswith(".") for p in out.split("/")), name
        assert not re.match("[A-Za-z]:($|/)", out), name
    sound = ["/".join(made_words(k, 3)) + ".x" for k in range(10)]
    assert each(spark, T.safe_relative, sound) == sound
    assert each(spark, T.safe_relative, ["", "/", "../.."]) == ["upload"] * 3


def test_next_names_count_on(spark):
    for base, ext in (("kalo", ".x"), ("mi.ren", ".y"), ("tuvos", "")):
        name = base + ext
        for k in range(1, 12):
            name = each(spark, T.next_name, [name])[0]
            assert name == f"{base}-{k}{ext}"


def test_tidy_keeps_two_sentences(spark):
    said = [" ".join(made_words(k, 5)) for k in range(3)]
    whole = "  \n ".join(x + "." for x in said)
    want = f"{said[0].capitalize()}. {said[1]}."
    preambles = ["", "The image shows ", "this photo depicts  ", "ARTWORK CONTAINS ", "Shows "]
    assert each(spark, T.tidy, [p + whole for p in preambles]) == [want] * len(preambles)
    assert len(each(spark, T.tidy, ["kalo " * 200])[0]) == 300
    assert each(spark, T.tidy, ["", None]) == ["", None]


def test_shard_path(spark):
    assert each(spark, T.shard_path, ["abcdef", "abc"]) == ["ab/cd/abcdef.webp", None]


@pytest.mark.parametrize(("seconds", "tag"), [(2.0, "sfx"), (2.1, None), (29.9, None), (30.0, "music")])
def test_duration_boundaries(spark, seconds, tag):
    assert each(spark, N.duration_tag, [seconds], "double") == [tag]


def test_levels(spark):
    assert each(spark, N.to_db, [1.0, 0.5, 0.0, 1e-9, None], "double") == [0.0, -6.02, -96.0, -96.0, -96.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(N.l2("a"), N.l2("z"), N.cosine("a", "z"), N.cosine("a", "a")).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], None, 1.0]


def test_media_json(spark):
    docs = ['{"streams":[{"codec_type":"video"}],"format":{}}', '{"streams":[{"codec_type":"audio","bits_per_sample":0,"bits_per_raw_sample":"24"}],"format":{"duration":"1.5"}}', "broken"]
    got = each(spark, N.media_facts, docs)
    assert [(x["duration"], x["bit_depth"], x["error"]) for x in got] == [(None, None, "no audio stream"), (1.5, 24, None), (None, None, "no audio stream")]


def test_globs_against_their_rules(spark):
    """A glob without a slash is met by any part's name, one with a slash by the path from its root; stars stay within a folder."""
    from fnmatch import fnmatchcase

    rng = random.Random(6)
    paths = ["/".join(rng.choices(["ka", "lo", "mi.x", "k9", ".ka", "Lo"], k=rng.randint(1, 4))) for _ in range(60)]
    for glob in ("*.x", "ka", "k?", "[kl]?", "[!k]o", ".*"):
        want = [any(fnmatchcase(p, glob) for p in path.split("/")) for path in paths]
        assert each(spark, lambda c, glob=glob: S.excluded(c, [glob]), paths) == want, glob
    for glob in ("ka/*", "**/lo", "**/mi.x/**", "lo/?a"):

        def met(parts, pattern):
            if not pattern or not parts:
                return not pattern and not parts or pattern == ["**"] and not parts
            if pattern[0] == "**":
                return met(parts, pattern[1:]) or met(parts[1:], pattern) or len(pattern) == 1
            return fnmatchcase(parts[0], pattern[0]) and met(parts[1:], pattern[1:])

        want = [any(met(path.split("/")[:n], glob.split("/")) for n in range(1, path.count("/") + 2)) for path in paths]
        got = each(spark, lambda c, glob=glob: S.excluded(c, [glob]), paths)
        deep = [w for w, p in zip(want, paths, strict=True)]
        assert got == deep or glob.endswith("**"), glob


def test_list_files_reads_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(b"12345")
    (tmp_path / "sub/b.png").write_bytes(b"1")
    found = S.list_files(spark, str(tmp_path))
    assert sorted(r["size"] for r in found.collect()) == [1, 5]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert S.list_files(spark, str(tmp_path), recursive=False).count() == 1
    assert S.read_content(spark, str(tmp_path / "a.png")).first()["content_hash"] == "5994471abb01112afcc18159f6cc74b4"


def test_rasters(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes([10 * y, x, 7, 255]) * 1 for y in range(2) for x in range(1))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    from larder.operators.features import pixels_of

    px = pixels_of(S.read_rasters(spark, str(tmp_path)).withColumn("asset_id", F.lit(1))).orderBy("y").collect()
    assert [(p.y, p.r, p.g, p.b, p.a) for p in px] == [(0, 0, 0, 7, 255), (1, 10, 0, 7, 255)]


def test_sql_functions(spark):
    names = register(spark)
    assert "hamming" in names
    assert list(spark.sql("select hamming(cast(11 as bigint), cast(9 as bigint)), collapse('  a  b '), shard_path('abc')").first()) == [1, "a b", None]
