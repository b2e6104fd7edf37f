"""The export's files, read again, are the passages in order; one source holds most of them and spreads over ranges."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from loomspan.operators import export

KINDS = "id string, text string, source_id string, evidence_type string, surah int, ayah int, volume string, page string, hadith_number string, chapter string, arabic_text string, translation_ur string, grade string, grade_source string"


def docs(spark):
    rows = [(f"h{i:04}", f" text {i} " + "x" * (i % 90), "big", "hadith", None, None, "1", str(i), None, None, None, None, *(("sahih", "rev") if i % 3 == 0 else ("ungraded", None))) for i in range(500)]
    rows += [(f"v{i}", f"verse {i}", "book", "quran", 2 - i % 2, i, None, None, None, None, "orig" if i == 1 else " ", "third" if i == 2 else None, None, None) for i in range(1, 6)]
    rows += [("n", None, "empty", "tafsir", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KINDS).repartition(6)


def read(folder):
    """Each file's lines: a folder's text files in order of their names."""
    out = {}
    for d in Path(folder, "files").glob("file=*"):
        out[d.name.removeprefix("file=")] = "".join(f.read_text(encoding="utf-8") for f in sorted(d.glob("part-*")))
    return out


def test_files_read_again_are_the_passages(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        titles = spark.createDataFrame([("big", "Large Book"), ("book", "Verses")], "source_id string, title string")
        made = export.export(docs(spark), titles, f"{tmp_path}/out", most_bytes=2000)
        files = read(tmp_path / "out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    listed = {r.file: r for r in made.collect()}
    assert set(files) == set(listed) and len(files) > 10
    seen = {}
    for name, whole in files.items():
        head, note, _, body = whole.split("\n", 3)
        assert head == f"SOURCE: {listed[name].label}  (id: {listed[name].source_id})" and note == export.NOTE
        assert len(body.encode()) == listed[name].bytes <= 2000 and body.count("### ") == listed[name].n
        seen.setdefault(listed[name].source_id, []).append((listed[name].part, body))
    parts = sorted(seen["big"])
    assert [p for p, _ in parts] == list(range(len(parts))) and listed["big.part01"].label == f"Large Book (part 1/{len(parts)})"
    got = re.findall(r"### (.*)\n(.*)\n\n", "".join(b for _, b in parts))
    assert got == [(f"big, v1, p.{i}" + ("  (grade: sahih — rev)" if i % 3 == 0 else ""), f"text {i} " + "x" * (i % 90) if i % 90 else f"text {i}") for i in range(500)]
    for a, b in zip(parts, parts[1:], strict=False):  # no part could have held the next passage too
        assert len(a[1].encode()) + len(b[1].split("\n\n")[0].encode()) + 2 > 2000
    assert files["book"].split("\n", 3)[3].split("\n\n") == [*(f"### Qur'an {2 - i % 2}:{i}\n" + ("Arabic: orig\n" if i == 1 else "") + f"English: verse {i}" + ("\nUrdu: third" if i == 2 else "") for i in (1, 3, 5, 2, 4)), ""]
    assert files["empty"].startswith("SOURCE: empty  (id: empty)\n") and listed["empty"].n == 1
    lines = "".join(f.read_text(encoding="utf-8") for f in sorted(Path(tmp_path, "out/INDEX").glob("part-*"))).splitlines()
    assert len(lines) == len(listed) and "big.part01" in lines[0] and re.fullmatch(r"- \*\*empty\*\* — 1 passages \(0\.0 MB\) → `empty`", lines[-1])


def test_without_a_cap_a_source_is_one_file(spark, tmp_path):
    titles = spark.createDataFrame([], "source_id string, title string")
    made = {r.file: r.n for r in export.export(docs(spark), titles, f"{tmp_path}/out", only=("big", "book")).collect()}
    assert made == {"big": 500, "book": 5} and set(read(tmp_path / "out")) == {"big", "book"}
    sums = export.export_parts(docs(spark), 10**9).agg(F.sum("n")).first()[0]
    assert sums == 506
