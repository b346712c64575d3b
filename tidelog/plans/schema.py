"""The tables of an operation log.

``CHANGES`` has a row per delivered change, ``OPS`` a row per delivered op. Ids print as ``counter@peer``; a peer is an
unsigned 64-bit number in decimal text and compares as a number. An op with length n takes the ids counter ..
counter+n-1. ``val_json`` is JSON text, which keeps 5 apart from 5.0 and a key set to null apart from no key.
"""

CHANGES = "doc_id string, peer string, counter bigint, end_counter bigint, lamport bigint, ts bigint, deps array<string>, msg string, arrival bigint"
OPS = (
    "doc_id string, peer string, counter bigint, len bigint, lamport bigint, change_counter bigint, arrival bigint, container string, vkind string, pos bigint, map_key string, val_json string, "
    "del_start string, del_len bigint, move_from bigint, elem string, mark_len bigint, mark_key string, mark_info bigint, tree_target string, tree_parent string, fractional_index string"
)

#: The decoder's names of op kinds, by the kind of container, and the op log's own.
SPELLINGS = {
    ("Map", "LoroValue"): "insert", ("Map", "DeleteOnce"): "delete",
    ("List", "LoroValue"): "insert", ("List", "DeleteSeq"): "delete",
    ("MovableList", "LoroValue"): "insert", ("MovableList", "DeleteSeq"): "delete", ("MovableList", "ListMove"): "move", ("MovableList", "ListSet"): "set",
    ("Text", "Str"): "insert", ("Text", "DeleteSeq"): "delete", ("Text", "MarkStart"): "mark", ("Text", "Null"): "mark_end",
    ("Counter", "F64"): "counter", ("Counter", "I64"): "counter",
    ("Tree", "RawTreeMove"): "move",
}
#: Fixed value: what stands before the id of a child container where a value holds one.
CHILD = "🦜:"
#: Fixed value: what the name of a mergeable root begins with.
MERGEABLE = "🤝:"
