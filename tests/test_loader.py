"""Loading by content and by address, gzipped files, ids in GML."""

import gzip
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from geoloom import model
from geoloom.model import FeatureFrame, Meta
from geoloom.sources import catalog, container, geojson, gml, kml, shapefile, topojson


@pytest.fixture(scope="module")
def cells(spark):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "fid long, name string")
    x = F.col("fid").cast("double")
    shape = model.rectangle(x * 2, x, x * 2 + 1, x + 1)
    return FeatureFrame(rows.select("fid", shape.alias("geom"), F.struct("name").alias("props")), Meta("cells"))


def named(ff):
    return sorted(r[0] for r in ff.df.select("props.name").collect())


WRITERS = {
    "geojson": lambda f: geojson.collection_text(f).encode(), "topojson": topojson.to_bytes, "zip": shapefile.to_bytes, "kmz": kml.to_bytes,
    "gml": gml.to_bytes, "pbf": container.to_bytes,
}


@pytest.mark.parametrize("kind", sorted(WRITERS))
def test_bytes_are_known_by_their_content(spark, cells, kind):
    data = WRITERS[kind](cells)
    assert catalog.ending_of(data) == kind
    assert named(catalog.read(spark, gzip.compress(data))) == ["c0", "c1", "c2"]


def test_gzipped_files(spark, cells, tmp_path):
    for kind in ("geojson", "topojson", "pbf"):
        path = f"{tmp_path}/cells.{kind}.gz"
        catalog.write_file(spark, WRITERS[kind](cells), path)
        with open(path, "rb") as f:
            assert f.read(2) == b"\x1f\x8b"
        assert named(catalog.read(spark, path)) == ["c0", "c1", "c2"]


def test_an_address_is_fetched_once(spark, cells):
    asked, body = [], WRITERS["geojson"](cells)

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/cells.geojson?v=1"
        assert named(catalog.read(spark, address)) == named(catalog.read(spark, address)) == ["c0", "c1", "c2"]
        assert asked == ["/cells.geojson?v=1"]
        catalog.fetched(spark, address, again=True)
        assert len(asked) == 2
    finally:
        server.shutdown()


def test_gml_ids_are_unique(cells):
    ids = re.findall(r'gml:id="([^"]+)"', gml.to_bytes(cells).decode())
    assert len(ids) == len(set(ids)) == 6


def test_ending_of_odd_bytes():
    assert catalog.ending_of(b"\xef\xbb\xbf" + json.dumps([]).encode()) == "geojson"
    assert catalog.ending_of(b"") == "pbf"
