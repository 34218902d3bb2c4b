"""Queries over pages that share their URLs, against their SQL."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rillweave.plans import registry


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The same pages in two orders: 30 URLs of eight pages each, whose residues decide what happens to a URL; those of every other URL are equally long."""
    made = [{"page_id": k, "url": f"http://h{k % 30 % 4 * 'x'}.example/{('en', 'fr', 'x')[k % 3]}/{k % 30}", "html": f"<p>{'x' * (k % 2 * k % 7)} {k:03d} é</p>"} for k in range(240)]
    out = []
    for order in (made, made[::-1]):
        out.append(str(tmp_path_factory.mktemp("tables")))
        os.mkdir(f"{out[-1]}/pages.parquet")
        for i in range(16):  # enough files that pages are not dealt out anew
            pq.write_table(pa.Table.from_pylist(order[i * 15 : i * 15 + 15]), f"{out[-1]}/pages.parquet/{i:02d}.parquet")
    return out


def rows(table):
    names = sorted(table.schema.names)
    return sorted(tuple(r[n] for n in names) for r in table.to_pylist())


def found(spark, name, folders):
    """The rows of a query, which are the same whatever the order of pages."""
    got = [rows(registry.QUERIES[name](spark, f).toArrow()) for f in folders]
    assert got[0] == got[1]
    return got[0]


def from_sql(folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return rows(con.sql(sql).to_arrow_table())


def test_batch_stats_are_those_of_the_sql(spark, folders):
    assert found(spark, "batch_stats", folders) == from_sql(folders[0], registry.ORACLE_SQL["batch_stats"])


def permitted(folder, name):
    """Every row that the SQL may give: those that tie for the first place, of which a run of it takes any one."""
    sql = registry.ORACLE_SQL[name]
    assert "row_number()" in sql
    return from_sql(folder, sql.replace("row_number()", "rank()"))


def test_what_store_generations_holds_is_permitted(spark, folders):
    got, may = found(spark, "store_generations", folders), permitted(folders[0], "store_generations")
    url = 3  # columns come by name
    assert set(got) <= set(may) and len(set(may)) > len(got)
    assert [r[url] for r in sorted(got, key=lambda r: r[url])] == sorted({r[url] for r in may})


def test_point_reads_are_permitted_and_find_what_a_compaction_keeps(spark, folders):
    got, may = found(spark, "store_point_reads", folders), permitted(folders[0], "store_point_reads")
    assert set(got) <= set(may) and len(set(may)) > len(got)
    assert sorted(page for _, page, _ in got) == sorted({page for _, page, _ in may})
    assert {md5 for md5, _, _ in got} <= {r[0] for r in found(spark, "store_generations", folders)}


def test_store_stats_add_up_what_the_store_lists(spark, folders):
    (got,) = found(spark, "store_stats", folders)
    listed, may = found(spark, "store_current", folders), permitted(folders[0], "store_current")
    size, url = 2, 4  # columns come by name
    assert got == (len(listed), sum(r[size] for r in listed)) and set(listed) <= set(may)
    sizes = [[r[size] for r in may if r[url] == u] for u in {r[url] for r in may}]
    assert len(sizes) == got[0] and sum(map(min, sizes)) <= got[1] <= sum(map(max, sizes))
    assert sum(map(min, sizes)) < sum(map(max, sizes))  # or the pages wouldn't tie


def larger_first(folder, name, of):
    """The rows that the SQL gives where ties go to the larger size, by column `of`; only those that this leaves nothing open for."""
    sql, order = registry.ORACLE_SQL[name], "ORDER BY stored_at DESC"
    assert order in sql
    told = {}
    for r in from_sql(folder, sql.replace("row_number()", "rank()").replace(order, f"{order}, strlen(content) DESC")):
        told.setdefault(r[of], set()).add(r)
    return {k: one for k, (one, *more) in told.items() if not more}


def test_store_generations_differs_from_its_sql_only_by_what_that_leaves_open(spark, folders):
    url = 3
    told, may = larger_first(folders[0], "store_generations", url), permitted(folders[0], "store_generations")
    assert len({r for r in may if r[url] in told}) > len(told) > 0  # the SQL as it is leaves these open
    assert {r[url]: r for r in found(spark, "store_generations", folders) if r[url] in told} == told


def test_point_reads_differ_from_their_sql_only_by_what_that_leaves_open(spark, folders):
    page = 1
    told, may = larger_first(folders[0], "store_point_reads", page), permitted(folders[0], "store_point_reads")
    assert len({r for r in may if r[page] in told}) > len(told) > 0
    assert {r[page]: r for r in found(spark, "store_point_reads", folders) if r[page] in told} == told


def test_store_stats_are_those_of_the_sql_where_ties_go_to_the_larger_size(spark, folders):
    url, sql = 4, registry.ORACLE_SQL["store_stats"]
    told = larger_first(folders[0], "store_current", url)
    assert found(spark, "store_stats", folders) == from_sql(folders[0], sql.replace("ORDER BY stored_at DESC", "ORDER BY stored_at DESC, strlen(content) DESC"))
    assert told and {r[url]: r for r in found(spark, "store_current", folders) if r[url] in told} == told


#: What the code does at ties, as SQL: nothing is open then.
WHOLE_ORDER = "ORDER BY stored_at DESC, strlen(content) DESC, md5(content) DESC"


def from_whole_order(folder, name):
    """The rows of the SQL with ties settled; the same whichever rows it numbers first."""
    sql, order = registry.ORACLE_SQL[name], "ORDER BY stored_at DESC"
    assert order in sql
    got = from_sql(folder, sql.replace(order, WHOLE_ORDER))
    assert sorted(set(from_sql(folder, sql.replace("row_number()", "rank()").replace(order, WHOLE_ORDER)))) == sorted(set(got))
    return got


def test_store_generations_are_those_of_the_sql_with_ties_settled(spark, folders):
    assert found(spark, "store_generations", folders) == from_whole_order(folders[0], "store_generations")


def test_point_reads_are_those_of_the_sql_with_ties_settled(spark, folders):
    assert found(spark, "store_point_reads", folders) == from_whole_order(folders[0], "store_point_reads")


def test_store_stats_and_what_they_add_up_are_those_of_the_sql_with_ties_settled(spark, folders):
    assert found(spark, "store_stats", folders) == from_whole_order(folders[0], "store_stats")
    assert found(spark, "store_current", folders) == from_whole_order(folders[0], "store_current")
