"""Binary tree files, written here from the text examples with an independent writer."""

import struct

import numpy as np
import pytest

from fixtures import EXAMPLES, tables
from grovewise import Forest
from grovewise.sources.treefile import Store, facts, tables_from_file

CODES = {"i1": 0, "u1": 1, "i4": 4, "u4": 5, "u8": 7, "f8": 9}


def write(path, arrays):
    """Header, descriptors, names, and arrays at multiples of 8 bytes, names in order."""
    names = sorted(arrays)
    at = 64 * (1 + len(names))
    keys, places, data = b"".join(n.encode() for n in names), [], b""
    start = at + len(keys)
    data = b"\0" * (-start % 8)
    for n in names:
        places.append((start + len(data), len(arrays[n])))
        data += arrays[n].tobytes()
        data += b"\0" * (-(start + len(data)) % 8)
    head = struct.pack("<8sHHIQ40x", b"\x89KAS\r\n\x1a\n", 1, 0, len(names), start + len(data))
    for n, (place, length) in zip(names, places):
        head += struct.pack("<B7xQQQQ24x", CODES[arrays[n].dtype.str.lstrip("<|")], at, len(n), place, length)
        at += len(n)
    path.write_bytes(head + keys + data)
    return str(path)


def ragged(values, kind="u1"):
    return np.array([x for v in values for x in v], kind), np.cumsum([0, *map(len, values)]).astype("u4")


def arrays_of(t, times=True):
    rows = lambda df, by: df.orderBy(by).collect()
    n, s, m = rows(t.nodes, "node_id"), rows(t.sites, "site_id"), rows(t.mutations, "mutation_id")
    e = t.edges.collect()
    null = lambda x: -1 if x is None else x
    out = {"format/name": np.frombuffer(b"tskit.trees", "i1"), "format/version": np.array([12, 7], "u4"), "sequence_length": np.array([t.sequence_length], "f8"), "uuid": np.frombuffer(b"0-1-2", "i1"), "time_units": np.frombuffer(b"unknown", "i1")}
    out |= {"nodes/flags": np.array([r.is_sample for r in n], "u4"), "nodes/time": np.array([r.time for r in n], "f8"), "nodes/population": np.array([null(r.population) for r in n], "i4"), "nodes/individual": np.array([null(r.individual) for r in n], "i4")}
    out |= {f"edges/{c}": np.array([r[c] for r in e], k) for c, k in (("left", "f8"), ("right", "f8"), ("parent", "i4"), ("child", "i4"))}
    out["sites/position"] = np.array([r.position for r in s], "f8")
    out["sites/ancestral_state"], out["sites/ancestral_state_offset"] = ragged([r.ancestral_state.encode() for r in s])
    out |= {"mutations/site": np.array([r.site_id for r in m], "i4"), "mutations/node": np.array([r.node for r in m], "i4"), "mutations/parent": np.array([null(r.parent) for r in m], "i4")}
    out["mutations/derived_state"], out["mutations/derived_state_offset"] = ragged([r.derived_state.encode() for r in m])
    if times:
        out["mutations/time"] = np.full(len(m), np.nan)
    out["individuals/flags"] = np.array([0, 7], "u4")
    out["individuals/location"], out["individuals/location_offset"] = ragged([[], [0.5, 2.0]], "f8")
    out["individuals/parents"], out["individuals/parents_offset"] = ragged([[-1, 1], []], "i4")
    out["populations/metadata"], out["populations/metadata_offset"] = ragged([b"", b"{}", b""])
    return out


def content(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", EXAMPLES)
def test_tables_of_a_file_are_those_written(spark, tmp_path, name):
    t = tables(spark, name)
    got = tables_from_file(spark, write(tmp_path / "x.trees", arrays_of(t)), rows=2)
    assert got.sequence_length == t.sequence_length
    for c in ("nodes", "edges", "sites", "mutations"):
        assert getattr(got, c).dtypes == getattr(t, c).dtypes
        assert content(getattr(got, c)) == content(getattr(t, c))


def test_statistics_of_a_file(spark, tmp_path):
    t = tables(spark, "multi_derived_states")
    path = write(tmp_path / "x.trees", arrays_of(t, times=False))
    assert Forest.from_file(spark, f"file://{path}").diversity().first()[0] == pytest.approx(2)


def test_optional_tables_and_facts(spark, tmp_path):
    path = write(tmp_path / "x.trees", arrays_of(tables(spark, "paper_ex")))
    got = tables_from_file(spark, path)
    assert [tuple(r) for r in got.individuals.orderBy("individual_id").collect()] == [(0, 0, [], [-1, 1]), (1, 7, [0.5, 2.0], [])]
    assert got.migrations.count() == 0 and got.mutations.where("time IS NOT NULL").count() == 0
    f = facts(path)
    assert (f["sequence_length"], f["uuid"], f["time_units"], f["num_nodes"], f["num_sites"], f["num_populations"], f["num_migrations"]) == (10, "0-1-2", "unknown", 9, 3, 3, 0)


def test_states_of_any_length(spark, tmp_path):
    a = arrays_of(tables(spark, "paper_ex"))
    a["sites/ancestral_state"], at = ragged([b"", "äß".encode(), b"ACGT"])
    a["sites/ancestral_state_offset"] = at.astype("u8")
    got = tables_from_file(spark, write(tmp_path / "x.trees", a), rows=1).sites.orderBy("site_id").collect()
    assert [r.ancestral_state for r in got] == ["", "äß", "ACGT"]


def test_other_files_are_errors(spark, tmp_path):
    a = arrays_of(tables(spark, "paper_ex"))
    path = write(tmp_path / "x.trees", a)
    whole = (tmp_path / "x.trees").read_bytes()
    (tmp_path / "cut").write_bytes(whole[:-8])
    (tmp_path / "text").write_text("no tables here")
    with pytest.raises(ValueError, match="header says"):
        Store(str(tmp_path / "cut"))
    with pytest.raises(ValueError, match="not a store"):
        Store(str(tmp_path / "text"))
    with pytest.raises(ValueError, match="no tree sequence"):
        Store(write(tmp_path / "y", a | {"format/name": np.frombuffer(b"other", "i1")}))
    del a["edges/child"]
    with pytest.raises(Exception, match="no array edges/child"):
        tables_from_file(spark, write(tmp_path / "z", a)).edges.collect()
    with Store(path) as s:
        assert len(s) > 20
