"""Recordings in files: ranges, seams, headers and fingerprints."""

import hashlib
import math
import pathlib
import random
import wave

import pytest

from cueloom.session import scratch_dir
from cueloom.sources import pcm, signals


def local(path):
    return pathlib.Path("/" + path.removeprefix("file:").lstrip("/"))


def recordings(seed=1):
    rng = random.Random(seed)
    return {m: [rng.randrange(-40000, 40000) for _ in range(n)] for m, n in ((1, 1), (2, 331), (3, 5000))}


def frame(spark, given):
    rows = [(m, i, x, 250) for m, xs in given.items() for i, x in enumerate(xs)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "media_id long, i long, sample long, rate int").repartition(5)


@pytest.mark.parametrize("range_bytes", [2, 34, 1 << 20])
def test_levels_of_files_equal_levels_of_samples(spark, range_bytes):
    given = {m: [max(-32768, min(32767, x)) for x in xs][:400] for m, xs in recordings().items()}
    samples = frame(spark, given)
    got = pcm.pcm_levels(pcm.write_pcm(samples, scratch_dir(spark, "pcm"), 250), range_bytes=range_bytes, block_bytes=7).collect()
    want = signals.rms_levels(samples).collect()
    assert sorted((int(r.media_id), r.win, r.rms) for r in got) == sorted((r.media_id, r.win, r.rms) for r in want)


def test_fingerprints_do_not_depend_on_the_parts(spark):
    given = recordings()
    one = pcm.fingerprints(pcm.write_pcm(frame(spark, given).coalesce(1), scratch_dir(spark, "pcm"), 250)).collect()
    want = {str(m): hashlib.sha256(b"".join(max(-32768, min(32767, x)).to_bytes(2, "little", signed=True) for x in xs)).hexdigest()
            for m, xs in given.items()}
    assert {r.media_id: r.sha256 for r in one} == want and {r.media_id: r.frames for r in one} == {"1": 1, "2": 331, "3": 5000}
    gap = frame(spark, {1: [5] * 90}).where("i <> 40")
    parts = pcm.write_pcm(gap, scratch_dir(spark, "pcm"), 250)
    assert parts.where("first = 41").count() == 1 and parts.agg({"frames": "sum"}).first()[0] == 89


def test_wav_headers(spark):
    folder = scratch_dir(spark, "wav")
    local(folder).mkdir(parents=True)
    xs = recordings()[2]
    data = b"".join(max(-32768, min(32767, x)).to_bytes(2, "little", signed=True) for x in xs)
    for name, channels, width in (("good", 1, 2), ("stereo", 2, 2), ("bytes", 1, 1)):
        with wave.open(str(local(folder) / f"{name}.wav"), "wb") as w:
            w.setparams((channels, width, 8000, 0, "NONE", "none"))
            w.writeframes(data)
    whole = (local(folder) / "good.wav").read_bytes()
    # Another chunk before the samples, and a size beyond the end of the file.
    (local(folder) / "odd.wav").write_bytes(whole[:12] + b"LIST\x03\x00\x00\x00abc\x00" + whole[12:40] + b"\xff\xff\xff\x7f" + data[:-1])
    (local(folder) / "empty.wav").write_bytes(b"")
    (local(folder) / "text.wav").write_bytes(b"no sound at all")
    parts, rest = pcm.wav_parts(spark, folder)
    assert sorted((r.path.split("/")[-1], r.frames, r.skip, r.rate) for r in parts.collect()) == [
        ("good.wav", 331, 44, 8000), ("odd.wav", 330, 56, 8000)]
    assert sorted(r.path.split("/")[-1] for r in rest.collect()) == ["bytes.wav", "stereo.wav", "text.wav"]
    levels = {r.win: r.rms for r in pcm.pcm_levels(parts.where("skip = 44")).collect()}
    clipped = [max(-32768, min(32767, x)) for x in xs]
    assert levels == {0: math.sqrt(sum(x * x for x in clipped[:160]) / 160), 1: math.sqrt(sum(x * x for x in clipped[160:320]) / 160),
                      2: math.sqrt(sum(x * x for x in clipped[320:]) / 11)}
    with pytest.raises(Exception, match="ends"):
        local(parts.where("skip = 56").first()["path"]).write_bytes(whole[:100])
        pcm.fingerprints(parts.where("skip = 56")).collect()


# --- subtitle files ---


def test_published_files_and_their_manifest(spark):
    from pyspark.sql import functions as F

    from cueloom.sources import sinks

    cues = spark.createDataFrame(
        [(m, f"{i}", i, float(i), i + 0.5, f"line {i}", "T" if i % 2 else None, None) for m in (1, 2) for i in range(5)],
        "media_id long, id string, ordinal long, start double, end double, source string, translated string, speaker string")
    lines, folder = sinks.render_ass(sinks.cue_events(cues)), scratch_dir(spark, "published")
    base = F.concat(F.lit("m"), F.col("media_id").cast("string"))
    for _ in range(2):  # again over the same names
        manifest = sinks.publish_ass(lines, folder, base, F.lit("en"), F.lit("zh_TW")).collect()
        files = {f.name: f.read_bytes() for f in local(folder).iterdir()}
        assert sorted(files) == sorted(f"m{m}.{x}.ass" for m in (1, 2) for x in ("source", "translated", "en-zh-tw"))
        assert {r.name: (r.lines, r.bytes, r.sha256) for r in manifest} == {
            n: (c.count(b"\n"), len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    shown = [x.rsplit(",,", 1)[1] for x in files["m1.en-zh-tw.ass"].decode().splitlines() if x.startswith("Dialogue:")]
    assert shown == ["line 0", "T\\Nline 1", "line 2", "T\\Nline 3", "line 4"]
    with pytest.raises(Exception, match="languages"):
        sinks.publish_ass(lines, scratch_dir(spark, "none"), base, F.lit("en"), F.lit(None).cast("string"))
