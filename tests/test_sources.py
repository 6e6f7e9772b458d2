"""Files of other layouts, written here as their formats say."""

import gzip
import json
import struct
import threading
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from loomframe.config import empty_cache, keep
from loomframe.dataset import memory_dataset
from loomframe.operators.complete import complete_chain, complete_dataset
from loomframe.sources.anndata import as_anndata, read_annotated, write_annotated
from loomframe.sources.export import files_to_zarr, write_files, zarr_to_files
from loomframe.sources.store import ParquetDataset, open_dataset, save


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


@pytest.fixture
def flat(tmp_path):
    root = tmp_path / "set"
    put(root / "daf.json", {"version": [1, 0]})
    put(root / "scalars/title.json", {"type": "String", "value": "t"})
    put(root / "axes/cell.txt", b"A\nB\nC\nD\n")
    put(root / "axes/gene.txt", b"X\nY\n")
    put(root / "vectors/cell/donor.json", {"format": "dense", "eltype": "Int32"})
    put(root / "vectors/cell/donor.data", np.array([1, 2, 3, 4], "<i4").tobytes())
    put(root / "vectors/cell/label.json", {"format": "dense", "eltype": "String"})
    put(root / "vectors/cell/label.txt", b"a\n\nc\nd\n")
    put(root / "vectors/cell/flag.json", {"format": "sparse", "eltype": "Bool", "indtype": "UInt32"})
    put(root / "vectors/cell/flag.nzind", np.array([1, 4], "<u4").tobytes())
    put(root / "vectors/cell/sv.json", {"format": "sparse", "nzind": {"format": "dense", "eltype": "Int64", "n_elements": 1}, "nzval": {"format": "dense", "eltype": "Float64", "n_elements": 1}})
    put(root / "vectors/cell/sv.nzind", np.array([2], "<i8").tobytes())
    put(root / "vectors/cell/sv.nzval", np.array([2.5]).tobytes())
    put(root / "matrices/cell/gene/dm.json", {"format": "dense", "eltype": "Float64"})
    put(root / "matrices/cell/gene/dm.data", np.arange(8.0).tobytes())
    put(root / "matrices/cell/gene/sm.json", {"format": "sparse", "eltype": "Float32", "indtype": "UInt32"})
    put(root / "matrices/cell/gene/sm.colptr", np.array([1, 2, 4], "<u4").tobytes())
    put(root / "matrices/cell/gene/sm.rowval", np.array([2, 1, 4], "<u4").tobytes())
    put(root / "matrices/cell/gene/sm.nzval", np.array([5, 6, 7], "<f4").tobytes())
    return root


def checked(ds):
    assert ds[". title"].collect() == "t" and ds.axis_entries("cell") == list("ABCD")
    assert ds["@ cell : donor"].collect() == {"A": 1, "B": 2, "C": 3, "D": 4} and ds["@ cell : label"].collect()["B"] == ""
    assert ds["@ cell [ flag ]"].collect() == ["A", "D"] and ds["@ cell : sv"].collect() == {"A": 0.0, "B": 2.5, "C": 0.0, "D": 0.0}
    assert ds["@ cell @ gene :: dm >- Sum"].collect() == {"X": 6.0, "Y": 22.0} and ds["@ cell @ gene :: sm >| Sum"].collect() == {"A": 6.0, "B": 5.0, "C": 0.0, "D": 7.0}


def test_flat_files(spark, flat):
    checked(open_dataset(spark, str(flat)))
    put(flat / "daf.json", {"version": [2, 0]})
    with pytest.raises(ValueError, match="version"):
        open_dataset(spark, str(flat))


def test_http(spark, flat):
    index = {str(p.relative_to(flat)): json.loads(p.read_text()) if p.suffix == ".json" else None for p in flat.rglob("*") if p.is_file()}
    put(flat / "metadata.json", index)
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(flat)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        checked(open_dataset(spark, f"http://127.0.0.1:{server.server_port}"))
        write_files(open_dataset(spark, str(flat)), str(flat / "again"))  # with metadata.zip
        assert json.loads((flat / "again/axes/metadata.json").read_text()) == ["cell", "gene"]
        checked(open_dataset(spark, f"http://127.0.0.1:{server.server_port}/again"))
        with pytest.raises(ValueError, match="read-only"):
            open_dataset(spark, f"http://127.0.0.1:{server.server_port}", "r+")
    finally:
        server.shutdown()


class Quiet(SimpleHTTPRequestHandler):
    def log_message(self, *args):
        pass


def node(shape, kind, codecs, chunk=None):
    return {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk or shape}}, "codecs": codecs, "fill_value": 0}


def test_zarr(spark, tmp_path):
    root, group, plain = tmp_path / "s.daf.zarr", {"zarr_format": 3, "node_type": "group"}, [{"name": "bytes"}]
    texts = lambda xs: struct.pack("<I", len(xs)) + b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in xs)
    for g in ("", "scalars/", "axes/", "vectors/", "vectors/cell/", "matrices/", "matrices/cell/", "matrices/cell/gene/", "matrices/cell/gene/sm/"):
        put(root / f"{g}zarr.json", group)
    for base, n, data in (
        ("scalars/pi", node([1], "float64", plain), np.array([3.5]).tobytes()),
        ("axes/cell", node([3], "string", [{"name": "vlen-utf8"}]), texts(["A", "B", "é"])),
        ("axes/gene", node([2], "string", [{"name": "vlen-utf8"}, {"name": "gzip"}]), gzip.compress(texts(["X", "Y"]))),
        ("matrices/cell/gene/sm/colptr", node([3], "int32", plain), np.array([1, 1, 3], "<i4").tobytes()),
        ("matrices/cell/gene/sm/rowval", node([2], "int32", plain), np.array([1, 3], "<i4").tobytes()),
        ("matrices/cell/gene/sm/nzval", node([2], "float32", plain), np.array([4, 5], "<f4").tobytes()),
    ):
        put(root / f"{base}/zarr.json", n)
        put(root / f"{base}/c/0", data)
    put(root / "vectors/cell/zero/zarr.json", node([3], "int16", plain))
    inner = {"chunk_shape": [1, 2], "codecs": [{"name": "bytes"}, {"name": "gzip"}]}
    chunks = [gzip.compress(np.array(x, "<f8").tobytes()) for x in ([1, 2], [3, 0], [4, 5])]
    at = 4 * 16 + 4 + np.cumsum([0, *map(len, chunks)])
    index = b"".join(struct.pack("<QQ", int(a), len(c)) for a, c in zip(at, chunks)) + b"\xff" * 16
    put(root / "matrices/cell/gene/dm/zarr.json", node([2, 3], "float64", [{"name": "sharding_indexed", "configuration": inner}]))
    put(root / "matrices/cell/gene/dm/c/0/0", index + b"\0" * 4 + b"".join(chunks))
    ds = open_dataset(spark, str(root))
    assert ds[". pi"].collect() == 3.5 and ds.axis_entries("cell") == ["A", "B", "é"] and ds["@ cell : zero >> Sum"].collect() == 0
    assert ds["@ cell @ gene :: dm"].collect() == {("A", "X"): 1.0, ("B", "X"): 2.0, ("é", "X"): 3.0, ("A", "Y"): 4.0, ("B", "Y"): 5.0, ("é", "Y"): 0.0}
    assert ds["@ gene @ cell :: sm >| Sum"].collect() == {"X": 0.0, "Y": 9.0}


def test_zarr_of_several_chunks(spark, tmp_path):
    root, group, plain = tmp_path / "m.daf.zarr", {"zarr_format": 3, "node_type": "group"}, [{"name": "bytes"}]
    texts = lambda xs: struct.pack("<I", len(xs)) + b"".join(struct.pack("<I", len(x)) + x.encode() for x in xs)
    for g in ("", "axes/", "vectors/", "vectors/well/", "vectors/well/sv/", "matrices/", "matrices/well/", "matrices/well/dye/", "matrices/well/dye/sm/"):
        put(root / f"{g}zarr.json", group)
    r = np.random.default_rng(5)
    dense, some = r.integers(1, 9, (3, 7)).astype("<f8"), r.integers(0, 3, (3, 7))  # dyes by wells

    def write(base, a, kind, chunk, skip=()):
        put(root / f"{base}/zarr.json", node(list(a.shape), kind, plain, chunk))
        for at in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunk))):
            whole = np.zeros(chunk, a.dtype)  # chunks at the edges are whole
            own = a[tuple(slice(p * c, (p + 1) * c) for p, c in zip(at, chunk))]
            whole[tuple(slice(0, n) for n in own.shape)] = own
            if at not in skip:
                put(root / "/".join([base, "c", *map(str, at)]), whole.tobytes())

    for axis, n in (("well", 7), ("dye", 3)):
        put(root / f"axes/{axis}/zarr.json", node([n], "string", [{"name": "vlen-utf8"}], [2]))
        for k in range(-(-n // 2)):
            put(root / f"axes/{axis}/c/{k}", texts([f"{axis}{i}" if i < n else "" for i in range(2 * k, 2 * k + 2)]))
    write("vectors/well/volume", np.arange(7, dtype="<i4"), "int32", [3], skip=[(1,)])
    write("vectors/well/sv/nzind", np.array([1, 3, 7], "<i8"), "int64", [2])
    write("vectors/well/sv/nzval", np.array([1.5, 2.5, 3.5]), "float64", [2])
    write("matrices/well/dye/dm", dense, "float64", [2, 3])
    stored = [(c, w) for c in range(3) for w in range(7) if some[c, w]]
    write("matrices/well/dye/sm/colptr", np.array([1 + sum(c < k for c, _ in stored) for k in range(4)], "<i8"), "int64", [3])
    write("matrices/well/dye/sm/rowval", np.array([w + 1 for _, w in stored], "<i8"), "int64", [4])
    write("matrices/well/dye/sm/nzval", np.array([some[c, w] for c, w in stored], "<i8"), "int64", [5])
    ds = open_dataset(spark, str(root))
    wells, dyes = [f"well{i}" for i in range(7)], [f"dye{i}" for i in range(3)]
    assert ds.axis_entries("well") == wells and ds.axis_entries("dye") == dyes
    assert ds["@ well : volume"].collect() == dict(zip(wells, [0, 1, 2, 0, 0, 0, 6])) and ds["@ well : sv"].collect() == dict(zip(wells, [1.5, 0, 2.5, 0, 0, 0, 3.5]))
    assert ds["@ well @ dye :: dm"].collect() == {(w, d): dense[j, i] for i, w in enumerate(wells) for j, d in enumerate(dyes)}
    assert ds["@ well @ dye :: sm"].collect() == {(w, d): some[j, i] for i, w in enumerate(wells) for j, d in enumerate(dyes)}


def test_written_layouts_read_back(spark, flat, tmp_path):
    files_to_zarr(spark, str(flat), f"{tmp_path}/a.daf.zarr")
    checked(open_dataset(spark, f"{tmp_path}/a.daf.zarr"))
    zarr_to_files(spark, f"{tmp_path}/a.daf.zarr", f"{tmp_path}/b")
    checked(open_dataset(spark, f"{tmp_path}/b"))
    assert (tmp_path / "b/matrices/cell/gene/sm.rowval").read_bytes() == np.array([2, 1, 4], "<u8").tobytes()
    with pytest.raises(FileExistsError):
        zarr_to_files(spark, f"{tmp_path}/a.daf.zarr", f"{tmp_path}/b")


def test_completed_sets(spark, tmp_path):
    base = memory_dataset(spark, "base")
    base.add_axis("cell", list("ABC"))
    base.set_vector("cell", "age", [1, 2, 3])
    save(base, f"{tmp_path}/base")
    leaf = ParquetDataset(spark, f"{tmp_path}/leaf", "w")
    chain = complete_chain(open_dataset(spark, f"{tmp_path}/base"), f"{tmp_path}/base", leaf)
    chain.set_vector("cell", "kind", list("xyx"))
    leaf.flush()
    assert complete_dataset(spark, f"{tmp_path}/leaf")["@ cell : age / kind >> Sum"].collect() == {"x": 4, "y": 2}


def test_annotated_matrix_and_kept_results(spark, tmp_path):
    d = memory_dataset(spark)
    d.add_axis("cell", list("AB"))
    d.add_axis("gene", list("XYZ"))
    d.set_matrix("cell", "gene", "UMIs", [[1, 2, 3], [4, 5, 6]])
    d.set_vector("cell", "age", [3, 4])
    a = as_anndata(d)
    assert a.shape == (2, 3) and a.X.count() == 6 and a.obs.columns == ["name", "age"] and a.var_names == list("XYZ") and a.layers == {} and a.uns == {}
    d.add_axis("obs_pca_dim", ["1", "2"])
    d.set_matrix("cell", "obs_pca_dim", "pca", [[0.5, 1.5], [2.5, 3.5]])
    d.set_matrix("cell", "gene", "spliced", spark.createDataFrame([("A", "Y", 9)], "row string, col string, value long"), 0)
    d.set_scalar("lab", "x")
    write_annotated(d, f"{tmp_path}/ann")
    back = read_annotated(spark, f"{tmp_path}/ann")
    assert back.axis_entries("obs") == ["A", "B"] and back["@ obs : age"].collect() == {"A": 3, "B": 4} and back[". lab"].collect() == "x"
    assert back["@ obs @ var :: UMIs >> Sum"].collect() == 21 and back["@ obs @ var :: spliced >| Sum"].collect() == {"A": 9, "B": 0}
    assert back["@ obs @ obs_pca_dim :: pca"].collect() == {("A", "1"): 0.5, ("A", "2"): 1.5, ("B", "1"): 2.5, ("B", "2"): 3.5}
    with pytest.raises(FileExistsError):
        write_annotated(d, f"{tmp_path}/ann")
    first = keep(d, "@ cell : age >> Sum")
    assert keep(d, "@ cell : age >> Sum") is first
    d.set_vector("cell", "age", [1, 1], True)
    assert keep(d, "@ cell : age >> Sum").collect() == 2
    empty_cache()
