"""A folder of packages from files to pages."""

import io
import zipfile

import pytest

from quirespark import api
from quirespark.plans import packages as fixture

CHAPTER = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><h1 id="top">{title}</h1><p><a href="{target}">there</a> <img src="../img/a.png" alt="A"/></p><figure><img src="../img/a.png"/></figure><figure><img src="../img/no.png"/></figure></body></html>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0" unique-identifier="u"><metadata><dc:identifier id="u">urn:x:1</dc:identifier><dc:title>T</dc:title><dc:language>en</dc:language></metadata>
<manifest><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="img/a.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, data in {"META-INF/container.xml": fixture._CONTAINER, "OEBPS/content.opf": PACKAGE, "OEBPS/text/a.xhtml": CHAPTER.format(title="First", target="b.xhtml#top"), "OEBPS/text/b.xhtml": CHAPTER.format(title="Second", target="gone.xhtml"), "OEBPS/img/a.png": "x"}.items():
            archive.writestr(name, data)
    (folder / "sub").mkdir()
    (folder / "sub" / "one.epub").write_bytes(held.getvalue())
    (folder / "broken.epub").write_bytes(b"no archive")
    return api.library(spark, str(folder))


def test_inspection(library):
    found = {r.pub_id: r for r in api.inspected(library).collect()}
    assert (found["one"].version, found["one"].n_entries, found["one"].n_items, found["one"].n_missing, found["one"].n_places, found["one"].problems) == ("3.0", 5, 3, 0, 2, [])
    assert found["broken"].problems == ["unreadable"] and found["broken"].version is None
    assert [(r.title, r.identifier, r.language) for r in library.metadata.collect()] == [("T", "urn:x:1", "en")]


def test_validation_and_hash(library):
    findings = sorted((r.code, r.detail) for r in api.validated(library).collect())
    assert findings == [("FLOW_MISSING_FIGURE_ASSET", "OEBPS/img/no.png")] * 2 + [("FLOW_UNRESOLVED_ANCHOR", "gone.xhtml")]
    hashes = api.hashed(library).collect()
    assert [(r.doc_id, r.n_nodes) for r in hashes] == [("one", 10)] and len(hashes[0].sha256) == 64


def test_book(library, tmp_path, spark):
    rows = {r.file_name: r for r in api.book(library).collect()}
    one, other = rows["chapters/chapter-001.html"], rows["chapters/chapter-002.html"]
    assert (one.resource, one.title, one.previous, one.following, one.progress) == ("OEBPS/text/a.xhtml", "First", None, "chapters/chapter-002.html", "1 / 2")
    assert (other.title, other.previous, other.following) == ("Second", "chapters/chapter-001.html", None)
    assert '<a href="#n2-1">there</a>' in one.html and "<a>there</a>" in other.html and "<h1" in one.html
    assert [(r.place, r.level, r.title, r.target_id) for r in api.contents(library).orderBy("place").collect()] == [(1, 1, "First", "n1-1"), (2, 1, "Second", "n2-1")]
    api.written(api.contents(library), str(tmp_path / "contents"))
    assert spark.read.json(str(tmp_path / "contents")).count() == 2
