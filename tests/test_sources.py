from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom import staging
from rankloom.operators import search, tfidf
from rankloom.plans import matching
from rankloom.sources import artifacts, documents, tables, versions
from rankloom.streaming.scoring import score_stream


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if mode == "wb":
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def test_resumes_from_csv(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'ID,Resume_str,Category\n1,"line one\nline ""two"", x",IT\n2,,HR\n3,text,\n'
                                     '4,NA,IT\n5,"",IT\n6,ok,null\n7,fine,Sales\n')
    assert [tuple(r) for r in tables.load_resumes(spark, path).collect()] == [
        ("IT", 'line one\nline "two", x'), ("Sales", "fine")]
    with pytest.raises(ValueError):
        tables.load_jobs(spark, path)


def test_jobs_sample(spark, tmp_path):
    rows = "".join(f"{i},t{i % 3},same text\n" for i in range(50))
    path = write(tmp_path / "j.csv", "job_id,Job Title,Job Description\n" + rows)
    assert tables.load_jobs(spark, path).count() == 50
    assert tables.load_jobs(spark, path, sample_size=7, resume_count=9).count() == 7
    assert tables.load_jobs(spark, path, resume_count=9).count() == 9
    one, two = (sorted(r.job_id for r in tables.load_jobs(spark, path, 5, id_column="job_id").collect())
                for _ in range(2))
    assert one == two and len(set(one)) == 5
    with pytest.raises(ValueError):
        tables.load_jobs(spark, path, sample_size=51)


def test_titles_need_their_column(spark, tmp_path):
    assert tables.load_job_titles(spark, write(tmp_path / "a.csv", "title,x\ncook,1\n")).first().title == "cook"
    with pytest.raises(ValueError):
        tables.load_job_titles(spark, write(tmp_path / "b.csv", "name\ncook\n"))


def test_corpus_lines(spark, tmp_path):
    path = write(tmp_path / "lines.txt", "  a b \n\n\t\n c \nlast")
    assert [r.line for r in tables.load_corpus_lines(spark, path).collect()] == ["a b", "c", "last"]


def test_read_through_computes_once(spark, tmp_path):
    calls = []

    def load():
        calls.append(1)
        return spark.createDataFrame([(1, "The Cat"), (2, "")], "id long, text string")

    path = str(tmp_path / "cleaned")
    first = tables.load_or_clean(spark, path, load).orderBy("id").collect()
    second = tables.load_or_clean(spark, path, load).orderBy("id").collect()
    assert first == second and len(calls) == 1
    assert [r.text_cleaned for r in first] == ["cat", ""]       # '' stays apart from null


def docx(path, body):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/'
                         f'wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return str(path)


def test_bulk_load(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder / "a.txt", "first\r\nfile é")
    write(folder / "B.TXT", "")
    write(folder / "c.csv", "no")
    write(folder / "sub" / "d.txt", "not read")
    write(folder / "bad.txt", b"\xff\xfe\xfa", "wb")
    write(folder / "bad.docx", b"no zip", "wb")
    write(folder / "p.pdf", b"%PDF", "wb")
    docx(folder / "ok.docx", "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p>"
         "<w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p>")
    loaded, errors = documents.bulk_load(spark, str(folder))
    assert {r.filename: r.text for r in loaded.collect()} == {
        "a.txt": "first\r\nfile é", "B.TXT": "", "ok.docx": "one\ttwo\n\nend"}
    assert {r.path.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in errors.collect()} == {
        "bad.txt": "not UTF-8", "bad.docx": "unreadable docx", "p.pdf": "no PDF reader"}


def test_bulk_load_of_lists_and_files(spark, tmp_path):
    one, two = write(tmp_path / "x" / "a.txt", "x"), write(tmp_path / "y" / "a.txt", "y")
    other = write(tmp_path / "z" / "b.csv", "z")
    loaded, _ = documents.bulk_load(spark, [two, one, other])
    assert [tuple(r) for r in loaded.collect()] == [("a.txt", "y")]         # the last path wins
    assert documents.bulk_load(spark, one)[0].first().text == "x"
    assert documents.bulk_load(spark, [other])[0].count() == 0
    for bad in (str(tmp_path / "missing"), 7):
        with pytest.raises(ValueError):
            documents.bulk_load(spark, bad)


def test_versions(spark, tmp_path):
    base = str(tmp_path / "table")
    # Day-first labels of these would sort in another order.
    for i, version in enumerate(("20231231235959", "20240102000000", "20240301000000")):
        versions.save_version(spark.range(i + 1), base, 2, version)
    assert versions.list_versions(spark, base) == ["20240102000000", "20240301000000"]
    assert versions.load_version(spark, base).count() == 3
    assert versions.load_version(spark, base, "20240102000000").count() == 2
    assert versions.save_version(spark.range(1), base, 1) in [
        f"{base}/version={v}" for v in versions.list_versions(spark, base)]
    with pytest.raises(ValueError):
        versions.load_version(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        versions.save_version(spark.range(1), base, 0)
    with pytest.raises(ValueError):
        versions.save_version(spark.range(1), base, 1, "20200101000000")
    assert len(versions.list_versions(spark, base)) == 1


def test_artifacts(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id long, embedding array<double>")
    path = artifacts.save_embeddings(vectors, str(tmp_path / "e"), normalize=True)
    row = artifacts.load_embeddings(spark, path).first()
    assert (list(row.embedding), row.dim) == ([0.6, 0.8], 2)
    with pytest.raises(FileNotFoundError):
        artifacts.load_vectors(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        artifacts.save_vocabulary(vectors, str(tmp_path / "v"))


def test_staging_uses_the_named_folder(spark):
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3
    assert staging.staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert staged.inputFiles()[0].removeprefix("file://").startswith(staging.staging_root(spark))
    staging.release(spark)
    assert staging.list_folder(spark, f"{staging.staging_root(spark)}/rankloom") == []


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    texts = ["spark data pipelines", "nurse and patients", "soup kitchen cook", "data nurse", "", "bread"]
    resumes = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    jobs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[::-1])], "query_id long, text string")
    settings = tfidf.combined_settings(min_df=1, max_df=1.0)
    vocabulary, resume_vectors, job_vectors = matching.fit_combined(resumes, "doc_id", jobs, "query_id", settings)
    source = str(tmp_path / "requests")
    for part in range(20):
        jobs.where(F.pmod("query_id", F.lit(20)) == part).coalesce(1).write.mode("append").parquet(source)
    staged = staging.list_folder(spark, f"{staging.staging_root(spark)}/rankloom")
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    output = str(tmp_path / "out")
    query = score_stream(stream, resume_vectors, vocabulary, settings, 3, output, str(tmp_path / "state"))
    query.awaitTermination()
    columns = ["query_id", "rank", "doc_id", "score"]
    streamed = sorted(map(tuple, spark.read.parquet(output).select(*columns).collect()))
    assert streamed == sorted(map(tuple, search.top_k(job_vectors, resume_vectors, 3).select(*columns).collect()))
    assert spark.read.parquet(output).select("batch_id").distinct().count() > 1
    assert staging.list_folder(spark, f"{staging.staging_root(spark)}/rankloom") == staged


@pytest.mark.parametrize("text, read", [
    ("", ""), (None, ""), ("one\ttwo\n\n end ", "one\ttwo\n\n end "), ("a & b <c> \"d\" ]]>", "a & b <c> \"d\" ]]>"),
    ("x\r\ny\x00\x1cz", "x\n\nyz"), ("é ™ 漢 😀", "é ™ 漢 😀"), ("w " * 200_000, "w " * 200_000)])
def test_docx_files_are_read_back(text, read):
    assert documents.docx_text(documents.docx_bytes(text)) == read
    assert documents.docx_bytes(text) == documents.docx_bytes(text)


def test_files_as_rows_of_a_table(spark):
    rows = [("in/a.txt", b"first", 1), ("in/B.TXT", b"", 1), ("late/a.txt", b"last", 1), ("in/c.docx", documents.docx_bytes("doc"), 1),
            ("in/d.docx", None, 1), ("in/e.DOCX", b"no zip", 1), ("in/f.txt", b"\xff\xfe", 1), ("in/g.pdf", b"%PDF", 1),
            ("in/h.csv", b"1,2", 1), (None, b"nameless", 1), ("in/i.txt", None, 1)]
    table = spark.createDataFrame(rows, "path string, content binary, text int")
    loaded, errors = documents.load_file_table(table)
    assert {tuple(r) for r in loaded.collect()} == {("a.txt", "last"), ("B.TXT", ""), ("c.docx", "doc")}
    assert {r["path"] for r in errors.collect()} == {"in/d.docx", "in/e.DOCX", "in/f.txt", "in/g.pdf", "in/i.txt"}
    assert [t.count() for t in documents.load_file_table(table.where("false"))] == [0, 0]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    texts = ["", None, "é\n", "a\r\nb"] + [f"text {i}" for i in range(296)]
    table = tmp_path / "texts"
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(table))
    documents.write_text_files(spark.read.parquet(str(table)), "text", f"file:{tmp_path}/files")
    assert len(list((tmp_path / "files").iterdir())) == 300
    empty, others = staging.empty_files(spark, str(tmp_path / "files"))
    assert empty == [] and others == {".txt": (300, sum(p.stat().st_size for p in (tmp_path / "files").iterdir()))}
    read = documents._files(spark, [str(tmp_path / "files")], empty, others, "txt", "path", "content")
    assert read._jdf.queryExecution().toRdd().getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    loaded, errors = documents.bulk_load(spark, str(tmp_path / "files"))
    assert sorted(r.text for r in loaded.collect()) == sorted((t or "") + "\n" for t in texts) and errors.count() == 0
