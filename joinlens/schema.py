"""Tables, foreign-key edges and the groups of keys that joins make equal."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Partition:
    """Disjoint sets of hashable members (union by smallest name, path halving)."""

    def __init__(self) -> None:
        self._up: dict[Hashable, Hashable] = {}

    def find(self, x: Hashable) -> Hashable:
        self._up.setdefault(x, x)
        while self._up[x] != x:
            self._up[x] = self._up[self._up[x]]
            x = self._up[x]
        return x

    def union(self, a: Hashable, b: Hashable) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = sorted((a, b), key=repr)
            self._up[high] = low

    def groups(self) -> list[list]:
        out: dict[Hashable, list] = {}
        for x in self._up:
            out.setdefault(self.find(x), []).append(x)
        return sorted((sorted(g, key=repr) for g in out.values()), key=repr)


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()
    irrelevant: tuple[str, ...] = ()
    rows: int | None = None
    sample_rate: float = 1.0

    @property
    def relevant(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.irrelevant)


@dataclass(frozen=True)
class JoinEdge:
    left: str
    left_key: str
    right: str
    right_key: str

    def __str__(self) -> str:
        return f"{self.left}.{self.left_key} = {self.right}.{self.right_key}"


@dataclass(frozen=True)
class SchemaGraph:
    tables: dict[str, TableDef]
    edges: tuple[JoinEdge, ...] = field(default=())

    def __post_init__(self) -> None:
        for e in self.edges:
            for t, k in ((e.left, e.left_key), (e.right, e.right_key)):
                if t not in self.tables or k not in self.tables[t].columns:
                    raise ValueError(f"{e} names an unknown column")

    def key_groups(self) -> list[list[tuple[str, str]]]:
        """Keys linked by edges, directly or through others; the order of edges doesn't matter."""
        p = Partition()
        for e in self.edges:
            p.union((e.left, e.left_key), (e.right, e.right_key))
        return p.groups()

    def owners(self, column: str) -> list[str]:
        return [t.name for t in self.tables.values() if column in t.columns]

    def check(self, name: str, df: DataFrame) -> None:
        missing = set(self.tables[name].columns) - set(df.columns)
        if missing:
            raise ValueError(f"{name} has no {sorted(missing)}")


def _schema(tables: Iterable[TableDef], edges: str) -> SchemaGraph:
    """Edges as 'a.x = b.y', separated by commas."""
    parsed = []
    for text in filter(str.strip, edges.split(",")):
        left, right = (side.strip().split(".") for side in text.split("="))
        parsed.append(JoinEdge(left[0], left[1], right[0], right[1]))
    return SchemaGraph({t.name: t for t in tables}, tuple(parsed))


def _t(name: str, columns: str, pk: str = "", irrelevant: str = "", rows: int | None = None) -> TableDef:
    return TableDef(name, tuple(columns.split()), tuple(pk.split()), tuple(irrelevant.split()), rows)


def driver_schema() -> SchemaGraph:
    """The tables of the test data."""
    return _schema(
        [
            _t("region", "r_regionkey r_name", "r_regionkey"),
            _t("nation", "n_nationkey n_name n_regionkey", "n_nationkey"),
            _t("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "c_custkey"),
            _t("supplier", "s_suppkey s_name s_nationkey s_acctbal", "s_suppkey"),
            _t("part", "p_partkey p_name p_brand p_type p_size p_retailprice", "p_partkey"),
            _t("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "o_orderkey"),
            _t("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"),
            _t("documents", "doc_id text lang source n_chars", "doc_id"),
            _t("labels", "doc_id quality toxic", "doc_id"),
            _t("events", "event_id ts user_id event_type value props", "event_id"),
        ],
        "lineitem.l_orderkey = orders.o_orderkey, lineitem.l_partkey = part.p_partkey, lineitem.l_suppkey = supplier.s_suppkey, "
        "orders.o_custkey = customer.c_custkey, customer.c_nationkey = nation.n_nationkey, supplier.s_nationkey = nation.n_nationkey, "
        "nation.n_regionkey = region.r_regionkey, labels.doc_id = documents.doc_id",
    )


def stats_schema() -> SchemaGraph:
    """A question-and-answer site's published dump, its columns and declared sizes."""
    return _schema(
        [
            _t("badges", "Id UserId Date", "Id", "Id", 79851),
            _t("votes", "Id PostId VoteTypeId CreationDate UserId BountyAmount", "Id", "Id", 328064),
            _t("postHistory", "Id PostHistoryTypeId PostId CreationDate UserId", "Id", "Id", 303187),
            _t("posts", "Id PostTypeId CreationDate Score ViewCount OwnerUserId AnswerCount CommentCount FavoriteCount LastEditorUserId", "Id", "LastEditorUserId", 91976),
            _t("users", "Id Reputation CreationDate Views UpVotes DownVotes", "Id", "", 40325),
            _t("comments", "Id PostId Score CreationDate UserId", "Id", "Id", 174305),
            _t("postLinks", "Id CreationDate PostId RelatedPostId LinkTypeId", "Id", "Id", 11102),
            _t("tags", "Id Count ExcerptPostId", "Id", "Id", 1032),
        ],
        "comments.PostId = posts.Id, comments.UserId = users.Id, badges.UserId = users.Id, tags.ExcerptPostId = posts.Id, "
        "postLinks.PostId = posts.Id, postLinks.RelatedPostId = posts.Id, postHistory.PostId = posts.Id, postHistory.UserId = users.Id, "
        "votes.PostId = posts.Id, votes.UserId = users.Id, posts.OwnerUserId = users.Id",
    )


def movies_schema() -> SchemaGraph:
    """A public film database in its small, star-shaped form."""
    return _schema(
        [
            _t("title", "id imdb_index kind_id production_year phonetic_code season_nr episode_nr series_years", "id", "", 2528312),
            _t("movie_info_idx", "id movie_id info_type_id", "id", "id", 1380035),
            _t("movie_info", "id movie_id info_type_id", "id", "id", 14835720),
            _t("cast_info", "id movie_id nr_order role_id", "id", "id", 36244344),
            _t("movie_keyword", "id movie_id keyword_id", "id", "id", 4523930),
            _t("movie_companies", "id movie_id company_id company_type_id", "id", "id", 2609129),
        ],
        ", ".join(f"{t}.movie_id = title.id" for t in ("movie_info_idx", "movie_info", "cast_info", "movie_keyword", "movie_companies")),
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> None:
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
