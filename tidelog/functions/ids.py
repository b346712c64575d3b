"""Column expressions over op ids, peers and container names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The container kinds of the document model, by their number.
KINDS = ["Map", "List", "Text", "Tree", "MovableList", "Counter"]
#: Fixed value: the parent under which a deleted tree node stands.
DELETED_PARENT = "2147483647@18446744073709551615"


def peer_number(peer: Column) -> Column:
    """The unsigned 64-bit peer as a number, so that it compares as one; null if it is none."""
    return peer.try_cast("decimal(20,0)")


def op_id(counter: Column, peer: Column) -> Column:
    """``counter@peer``. For display only: printed ids do not sort as ids do."""
    return F.concat_ws("@", counter.cast("string"), peer.cast("string"))


def id_counter(printed: Column) -> Column:
    """The counter of a printed id; null if it is none within 32 bits."""
    return F.split_part(printed, F.lit("@"), F.lit(1)).try_cast("int").cast("bigint")


def id_peer(printed: Column) -> Column:
    return F.split_part(printed, F.lit("@"), F.lit(2)).try_cast("decimal(20,0)")


def container_kind(container: Column) -> Column:
    """The kind is what follows the last colon: names may hold colons themselves."""
    return F.substring_index(container, ":", -1)


def container_is_root(container: Column) -> Column:
    return container.startswith("cid:root-")


def container_name(container: Column) -> Column:
    """The name of a root, or the printed id of the op that made the container."""
    return F.regexp_extract(container, r"(?s)^cid:(?:root-)?(.*):[^:]*$", 1)


def container_id(root: Column, name: Column, kind: Column) -> Column:
    return F.concat(F.lit("cid:"), F.when(root, F.lit("root-")).otherwise(F.lit("")), name, F.lit(":"), kind)


def child_container(counter: Column, peer: Column, kind: Column) -> Column:
    """A child container is named by the op that placed it."""
    return F.concat(F.lit("cid:"), op_id(counter, peer), F.lit(":"), kind)


def atoms(length: Column) -> Column:
    """How many ids an op takes up."""
    return F.greatest(F.coalesce(length, F.lit(1)), F.lit(1))
