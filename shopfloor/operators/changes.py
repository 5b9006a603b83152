"""Change sets: per-row CRUD re-aimed as set-based table transitions.

(D1-D12, J6, J7, W5, T2, F11, A26.)  Each function takes the current table
and a DataFrame of changes and returns a dict of DataFrames -- at least
``target`` (the new table) -- plus ``rejects``/``report`` where the
reference answered with an error or a count.  Nothing is mutated.

Sequence semantics are kept without gathering a key's changes into one
place: "last write wins" is ``max_by(struct(value), seq)`` (a combinable
aggregate, so a key changed a million times is pre-aggregated per
partition), and the liveness of a row is the interval between its birth
and its first delete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .._shipping import ship_by_value as _ship_by_value
from ..functions.columns import as_of_date, as_of_timestamp, parse_id_list
from ..session import checkpoint_dir, shared_copy
from .ids import dense_ids, ids_in_place, next_id, ordered_copy
from .prefix import BLOCK, BLOCK_ROWS, in_blocks

ORDER_TYPES = {f.name: f.dataType for f in S.ORDERS.fields}
CREATE_REQUIRED = ["customer_name", "quantity", "subtotal_amount", "category", "subcategory"]
CREATE_DEFAULTS = {"status": "pending", "tax_rate": "0.0", "shipping_cost": "0.0"}
READ_ACTIONS = ["get_order", "get_stats", "search_orders"]   # request/response only

# The Python fold below runs inside executors; ship this module's code by
# value so executors do not need the package installed.
_ship_by_value(__name__)


def _typed(value: Column, field: str) -> Column:
    """Text from a command map -> the column's type (NULL if it does not parse)."""
    dt = ORDER_TYPES[field]
    if isinstance(dt, T.StringType):
        return value
    return value.try_cast(dt)


def _parsed_columns(data: Column) -> dict[str, Column]:
    """The fields that aren't text, as ``_t_`` columns: parsed once for all checks and for a create's row."""
    return {f"_t_{f}": _typed(data[f], f) for f, t in ORDER_TYPES.items()
            if f in S.ORDER_FIELDS and not isinstance(t, T.StringType)}


def _bad_value(data: Column, fields) -> Column:
    """True when a present, non-null value in the map does not parse."""
    return reduce(lambda a, b: a | b, [data[f].isNotNull() & F.col(f"_t_{f}").isNull() for f in fields
                                       if not isinstance(ORDER_TYPES[f], T.StringType)], F.lit(False))


def _any_field(fields, test) -> Column:
    """True when ``test`` holds for a field.  Checks written out one by one for all fields
    make generated code too long for the JVM to compile, at many times the cost of a row."""
    return F.exists(F.array(*[F.lit(f) for f in fields]), lambda f: F.coalesce(test(f), F.lit(False)))


def _missing_field(data: Column, fields) -> Column:
    """True when a field is not present; a value that is there needs no search among the keys."""
    return reduce(lambda a, b: a | b, [data[f].isNull() for f in fields]) & _any_field(
        fields, lambda f: ~F.coalesce(F.map_contains_key(data, f), F.lit(False)))


def _null_value(data: Column, fields) -> Column:
    """True when a field is present without a value."""
    return F.exists(F.map_values(data), lambda v: v.isNull()) & _any_field(
        fields, lambda f: F.map_contains_key(data, f) & data[f].isNull())


def _negative_value(fields) -> Column:
    """True when a present number is below 0."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_t_{f}") < 0, F.lit(False))
                                       for f in fields if f in S.NUMERIC_FIELDS], F.lit(False))


def _reject(df: DataFrame, reason: Column | str) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("seq", "action", F.col("oid").alias("order_id"), r.alias("reason"))


# ---------------------------------------------------------------------------
# Order commands, applied in sequence order
# ---------------------------------------------------------------------------

def apply_order_commands(target: DataFrame, commands: DataFrame, as_of: str | None = None,
                         allowed=S.ORDER_FIELDS, reliable_ids: bool = True,
                         next_base: DataFrame | None = None, constraints: bool = True) -> dict[str, DataFrame]:
    """Apply ``(seq, action, data)`` commands to ``orders``; ``data`` is the
    command's JSON text (parsed as ``map<string,string>``).

    Actions: ``create_order`` (D2: defaults for status, date, tax, shipping;
    id = max + 1, + 2 ... in seq order), ``update_order`` (D4: only the
    PRESENT allowed fields change), and ``delete_order`` (D6).  Anything else
    is rejected, as are updates and deletes without ``order_id`` (a 0 counts
    as missing, as in the reference), updates with no allowed field, values
    that do not parse, commands without a ``seq``, and updates/deletes of an
    id that does not exist at that point of the sequence.  Commands of equal
    ``seq`` are ordered by action, then payload.  The table's NOT NULL and CHECK constraints
    (numbers at least 0) also reject a command; for a table without them
    pass ``constraints=False``, and a present null sets NULL.

    Returns ``target``, ``changes`` (R4 feed rows), ``rejects``,
    ``report`` and ``delta``: only the touched rows -- ``(order_id, op,
    seq, fields...)`` with op upsert/delete -- whose size follows the batch,
    not the table (what a MERGE or a change log needs).  ``next_base``
    (one row, ``next_base`` column) replaces the ``max(order_id)`` scan.
    """
    ts = as_of_timestamp(as_of)
    parsed = F.from_json("payload", "map<string,string>")
    is_create = F.col("action") == "create_order"
    is_update = F.col("action") == "update_order"
    is_delete = F.col("action") == "delete_order"
    known = is_create | is_update | is_delete
    no_id = F.coalesce(F.col("oid"), F.lit(0)) == 0
    has_field = reduce(lambda a, b: a | b, [F.map_contains_key("data", f) for f in allowed])
    missing_req = _missing_field(F.col("data"), CREATE_REQUIRED)

    reason = (F.when(F.col("seq").isNull(), "no seq")
              .when(F.col("action").isin(READ_ACTIONS), "read-only action (not applied)")
              .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unknown action: "),
                                                                F.coalesce("action", F.lit("null"))))
              .when((is_update | is_delete) & no_id, "order_id is required")
              .when(is_update & ~has_field, "No fields to update")
              .when(is_create & missing_req, "missing required field")
              .when((is_create | is_update) & _bad_value(F.col("data"), allowed), "invalid value"))
    if constraints:
        reason = (reason.when((is_create | is_update) & _null_value(F.col("data"), allowed), "NULL not allowed")
                  .when((is_create | is_update) & _negative_value(allowed), "negative value"))
    d = F.col("data")

    def create_value(f):
        v = d[f] if isinstance(ORDER_TYPES[f], T.StringType) else F.col(f"_t_{f}")
        if f == "order_date":
            return F.coalesce(v, as_of_date(as_of))
        if f in CREATE_DEFAULTS:   # default only when the key is absent
            v = F.when(F.map_contains_key(d, f), v).otherwise(_typed(F.lit(CREATE_DEFAULTS[f]), f))
        return v.cast(ORDER_TYPES[f])

    def classified(rows):
        """Parsed once: what is wrong with a command, and a good create's fields (columns ``_n_...``)."""
        c = rows.withColumn("data", parsed).withColumns({"oid": d["order_id"].try_cast("long"), **_parsed_columns(d)})
        c = c.withColumn("_reason", reason)
        c = c.withColumn("_new", F.coalesce(is_create & F.col("_reason").isNull(), F.lit(False)))
        return c.select("seq", "action", "payload", "oid", "_reason", "_new",
                        *[F.when(F.col("_new"), create_value(f)).alias(f"_n_{f}") for f in S.ORDER_FIELDS])
    # One sorted copy holds all commands: equal seq is ordered by action, then
    # payload.  Rows are shuffled as they came, parsed and classified on their
    # way into the copy, and what their text holds isn't stored beside it, but
    # for a create's fields.  Without that copy, filter push-down inlines
    # from_json(payload) into every predicate of every branch.
    raw = commands.select("seq", "action", F.col("data").alias("payload"))
    checked = ordered_copy(raw, ["seq", "action", "payload"], classified, "_new")
    static_rejects = _reject(checked.filter(F.col("_reason").isNotNull()), F.col("_reason"))

    # -- creates: fresh ids in command order (W4), defaults (D2) --------------
    # Table, feed and delta below all read the same ids from that copy.
    created = ids_in_place(checked.filter("_new"), "order_id",
                           base=next_base if next_base is not None else next_id(target, "order_id"))
    created_rows = created.select("order_id", *[F.col(f"_n_{f}").alias(f) for f in S.ORDER_FIELDS],
                                  F.col("seq").alias("_bseq"))

    # -- the rows the batch names: all that follows is of the batch's size ----
    edits = (checked.filter(F.col("_reason").isNull() & ~F.col("_new"))
             .select(F.col("_mid").alias("_pos"), "seq", "action", "oid", parsed.alias("data"), "payload").checkpoint(eager=True))
    # Few ids and few fates are joined without a shuffle of the creates: the planner knows the size of a copy.
    asked = shared_copy(edits.select(F.col("oid").alias("_asked")).distinct(), "asked")
    # a batch that names no row doesn't search the table
    held = target.limit(0) if asked.isEmpty() else target.join(asked, target.order_id == F.col("_asked"), "left_semi")
    named = held.select(*S.ORDERS.names, F.lit(None).cast(checked.schema["seq"].dataType).alias("_bseq"))
    if reliable_ids:
        # read by deletes, updates, patches and delta: the table is searched once
        named = named.checkpoint(eager=True)
    # under new names: the copy keeps constraints of columns it no longer has, which a union trips over
    named = named.select(*[F.col(c).alias(c) for c in named.columns])
    state = named.unionByName(created_rows)
    births = state.join(asked, state.order_id == F.col("_asked"), "left_semi").select(
        F.col("order_id").alias("oid"), "_bseq", F.lit(True).alias("_found"))

    # -- a row lives from its birth to its first later delete ------------------
    # At equal seq a create is first ("create_order" sorts before "delete_order" and "update_order").
    placed = edits.join(births, "oid", "left")
    born = F.col("_found").isNotNull() & (F.col("_bseq").isNull() | (F.col("seq") >= F.col("_bseq")))
    died = placed.filter(born & is_delete).groupBy("oid").agg(F.min("_pos").alias("_died"))
    placed = placed.join(died, "oid", "left")
    applied = F.coalesce(born & F.when(is_delete, F.col("_pos") == F.col("_died"))
                         .otherwise(F.col("_died").isNull() | (F.col("_pos") < F.col("_died"))), F.lit(False))
    placed = placed.withColumn("_applied", applied)
    # read by fates and feed
    done = placed.filter("_applied").select("_pos", "seq", "action", "oid", "data", "payload").checkpoint(eager=True)
    up_applied = done.filter(is_update)
    del_applied = done.filter(is_delete)

    # last write wins per field; struct keeps "set to NULL" apart from "absent"
    fate = shared_copy(done.groupBy("oid").agg(
        *[F.max_by(F.struct(F.col("data")[f].alias("v")),
                   F.when(is_update & F.map_contains_key("data", f), F.col("_pos"))).alias(f"_p_{f}")
          for f in allowed],
        F.max_by("seq", F.when(is_update, F.col("_pos"))).alias("_useq"),
        F.min(F.when(is_delete, F.col("_pos"))).alias("_died"),
        F.min_by("seq", F.when(is_delete, F.col("_pos"))).alias("_dseq")), "fates")
    new_cols = [
        (F.when(F.col(f"_p_{f}").isNotNull(), _typed(F.col(f"_p_{f}.v"), f)).otherwise(F.col(f))
         if f in allowed else F.col(f)).cast(ORDER_TYPES[f]).alias(f)
        for f in S.ORDER_FIELDS]
    alive = state.join(fate, state.order_id == fate.oid, "left").filter(F.col("_died").isNull())
    new_target = (target.join(asked, target.order_id == F.col("_asked"), "left_anti").select(*S.ORDERS.names)
                  .unionByName(alive.select("order_id", *new_cols)))

    # -- R4 change feed --------------------------------------------------------
    changes = (created.select("order_id", F.lit("created").alias("action"),
                              F.col("payload").alias("data"), "seq")
               .unionByName(up_applied.select(F.col("oid").alias("order_id"), F.lit("updated").alias("action"),
                                              F.col("payload").alias("data"), "seq"))
               .unionByName(del_applied.select(F.col("oid").alias("order_id"), F.lit("deleted").alias("action"),
                                               F.lit(None).cast("string").alias("data"), "seq")))
    sev = F.create_map(*[x for k, v in S.CHANGE_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    changes = changes.select("seq", "order_id", "action", sev[F.col("action")].alias("severity"),
                             "data", ts.alias("timestamp"))

    rejects = static_rejects.unionByName(_reject(placed.filter(~F.col("_applied")), "Order not found"))
    report = (changes.groupBy("action").agg(F.count(F.lit(1)).alias("count"))
              .unionByName(rejects.agg(F.lit("rejected").alias("action"), F.count(F.lit(1)).alias("count"))))
    # -- delta: touched ids only --------------------------------------------
    last = F.coalesce("_useq", "_bseq")         # created then patched: once
    upserts = alive.filter(last.isNotNull()).select("order_id", F.lit("upsert").alias("op"), last.alias("seq"), *new_cols)
    deletes = named.join(fate.filter(F.col("_died").isNotNull()), named.order_id == fate.oid).select(
        "order_id", F.lit("delete").alias("op"), F.col("_dseq").alias("seq"),
        *[F.lit(None).cast(ORDER_TYPES[f]).alias(f) for f in S.ORDER_FIELDS])
    delta = upserts.unionByName(deletes)
    return {"target": new_target, "changes": changes, "rejects": rejects, "report": report,
            "delta": delta}


# ---------------------------------------------------------------------------
# creates
# ---------------------------------------------------------------------------

def _broken_constraints(required, not_negative) -> Column:
    """Array of what a row breaks: ``missing: a,b`` and ``negative: c``; empty if it is whole."""
    def names(label, cols, broken):
        found = F.array_compact(F.array(*[F.when(broken(F.col(c)), F.lit(c)) for c in cols]))
        return F.when(F.size(found) > 0, F.concat(F.lit(f"{label}: "), F.array_join(found, ",")))
    parts = ([names("missing", required, lambda c: c.isNull())] if len(required) else []) + \
        ([names("negative", not_negative, lambda c: c < 0)] if len(not_negative) else [])
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def create_rows(target: DataFrame, new_rows: DataFrame, id_col: str, order_by: list,
                required=(), defaults: dict | None = None, not_negative=()) -> dict[str, DataFrame]:
    """Append rows with ids max + 1, + 2, ... in ``order_by`` order.

    ``required`` columns must be non-NULL (P18), ``not_negative`` ones at
    least 0 where present (P17); ``defaults`` fill NULLs first (D2).
    Returns ``target`` (old rows + new), ``created``, ``rejects`` with a reason.
    """
    df = new_rows
    for k, v in (defaults or {}).items():
        df = df.withColumn(k, F.coalesce(F.col(k), v if isinstance(v, Column) else F.lit(v)))
    df = df.withColumn("_broken", _broken_constraints(required, not_negative))
    good = df.filter(F.size("_broken") == 0).drop("_broken")
    rejects = df.filter(F.size("_broken") > 0).withColumn("reason", F.array_join("_broken", "; ")).drop("_broken")
    created = dense_ids(good.drop(id_col) if id_col in good.columns else good, order_by, id_col,
                        base=next_id(target, id_col))
    created = created.select(*[F.col(f.name).cast(f.dataType) for f in target.schema.fields])
    return {"target": target.unionByName(created), "created": created, "rejects": rejects}


# ---------------------------------------------------------------------------
# D3: full replace
# ---------------------------------------------------------------------------

def replace_rows(target: DataFrame, rows: DataFrame, key: str, seq: str | None = None,
                 required: list[str] = (), not_negative: list[str] = ()) -> dict[str, DataFrame]:
    """D3: the source row replaces every non-key field of the target row.

    A row without one of the ``required`` fields, with a ``not_negative``
    one below 0, or without a given ``seq``, goes to ``rejects`` with a
    reason (P17, P18).

    Several source rows for one key: the last by ``seq`` wins (W5); without
    ``seq`` the one whose row is last in its text form, so that a key never
    gets two rows.  Keys missing from the target are returned as ``not_found``.
    """
    checked = rows.withColumn("_broken", _broken_constraints(required, not_negative))
    rejects = checked.filter(F.size("_broken") > 0).withColumn("reason", F.array_join("_broken", "; ")).drop("_broken")
    rows = checked.filter(F.size("_broken") == 0).drop("_broken")
    if seq:
        rejects = rejects.unionByName(without_position(rows, seq))
    src = last_per_key(rows, key, seq) if seq else _one_per_key(rows, key)
    src = src.select(*target.columns)
    keys = src.select(F.col(key).alias("_k"))
    kept = target.join(keys, target[key] == keys["_k"], "left_anti")
    found = src.join(target.select(key), key, "left_semi")
    not_found = src.join(target.select(key), key, "left_anti").select(key)
    return {"target": kept.unionByName(found), "replaced": found.select(key), "not_found": not_found,
            "rejects": rejects}


# ---------------------------------------------------------------------------
# Product patch, NULL means "leave"
# ---------------------------------------------------------------------------

def patch_products(products: DataFrame, patches: DataFrame, key: str = "product_id",
                   seq: str = "seq", fields=S.PRODUCT_PATCH_FIELDS,
                   as_of: str | None = None) -> dict[str, DataFrame]:
    """Each non-NULL field of a patch overwrites; NULL leaves the value.

    Several patches per product fold in ``seq`` order (last non-NULL per
    field wins; equal ``seq``: the greater value).  ``updated_at`` changes
    only on products with at least one non-NULL field; patches for unknown
    products are ``not_found``, patches without a ``seq`` ``rejects``.
    """
    fields = [f for f in fields if f in patches.columns]
    rejects, patches = without_position(patches, seq), patches.where(F.col(seq).isNotNull())
    last = patches.groupBy(F.col(key).alias("_pk")).agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq), F.col(f).alias("v"))))["v"].alias(f"_n_{f}") for f in fields],
        F.count_if(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])).alias("_nn"))
    j = products.join(last, products[key] == last["_pk"], "left")
    touched = F.coalesce(F.col("_nn") > 0, F.lit(False))
    cols = []
    for f in products.schema.fields:
        if f.name in fields:
            cols.append(F.coalesce(F.col(f"_n_{f.name}").cast(f.dataType), F.col(f.name)).alias(f.name))
        elif f.name == "updated_at":
            cols.append(F.when(touched, as_of_timestamp(as_of)).otherwise(F.col("updated_at")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    not_found = last.join(products.select(F.col(key).alias("_pk")), "_pk", "left_anti") \
        .select(F.col("_pk").alias(key))
    return {"target": j.select(*cols), "not_found": not_found, "rejects": rejects,
            "report": j.agg(F.count_if(touched).cast("bigint").alias("updated_rows"))}


# ---------------------------------------------------------------------------
# deletes
# ---------------------------------------------------------------------------

def delete_rows(target: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> dict[str, DataFrame]:
    """Rows whose key is in ``ids`` disappear; unknown ids are reported."""
    k = ids_key or key
    want = ids.select(F.col(k).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return {"target": target.join(want, key, "left_anti"),
            "deleted": target.join(want, key, "left_semi").select(key),
            "not_found": want.join(target.select(key), key, "left_anti")}


def soft_delete(products: DataFrame, ids: DataFrame, key: str = "product_id",
                as_of: str | None = None) -> DataFrame:
    """``is_active = false`` (and ``updated_at``) for the given ids."""
    want = ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = products.join(want, products[key] == want["_k"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (j.withColumn("is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))
            .withColumn("updated_at", F.when(hit, as_of_timestamp(as_of)).otherwise(F.col("updated_at")))
            .select(*products.columns))


# ---------------------------------------------------------------------------
# Status of many rows
# ---------------------------------------------------------------------------

def ids_from_text(texts: DataFrame, text_col: str = "ids", out: str = "order_id") -> DataFrame:
    """one id per row from comma text (``"1, 2,x, 4b"`` -> 1, 2, 4)."""
    return texts.select(F.explode(parse_id_list(text_col)).alias(out))


def set_status(target: DataFrame, ids: DataFrame, status, key: str = "order_id",
               ids_key: str | None = None) -> dict[str, DataFrame]:
    """Rows whose id is in ``ids`` get ``status``; unknown ids are
    ignored (as in the reference); ``report.updated_rows`` counts matches."""
    k = ids_key or key
    want = ids.select(F.col(k).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = target.join(want, target[key] == want["_k"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    st = status if isinstance(status, Column) else F.lit(status)
    return {"target": j.withColumn("status", F.when(hit, st).otherwise(F.col("status")))
                       .select(*target.columns),
            "report": j.agg(F.count_if(hit).cast("bigint").alias("updated_rows"))}


def set_customer_order_status(orders: DataFrame, changes: DataFrame, key: str = "customer_order_id",
                              seq: str | None = "seq",
                              domain=S.CUSTOMER_ORDER_STATUSES) -> dict[str, DataFrame]:
    """Per-order status changes, checked against the (case-sensitive)
    domain; the last valid change per order wins (equal ``seq``: the status
    last in the alphabet); rejects carry a reason, a missing ``seq`` too."""
    ok = F.coalesce(F.col("status").isin(list(domain)), F.lit(False))
    rejects = changes.filter(~ok).withColumn("reason", F.lit("invalid status"))
    good = changes.filter(ok)
    if seq:
        rejects, good = rejects.unionByName(without_position(good, seq)), good.filter(F.col(seq).isNotNull())
    last = (good.groupBy(key).agg(F.max(F.struct(seq, "status"))["status"].alias("_new"))
            if seq else good.groupBy(key).agg(F.max("status").alias("_new")))
    j = orders.join(last, key, "left")
    new = j.withColumn("status", F.coalesce("_new", "status")).select(*orders.columns)
    nf = last.join(orders.select(key), key, "left_anti").select(key)
    return {"target": new, "rejects": rejects, "not_found": nf,
            "report": j.agg(F.count("_new").cast("bigint").alias("updated_rows"))}


# ---------------------------------------------------------------------------
# upserts
# ---------------------------------------------------------------------------

def last_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record per key wins (``max`` over a struct that begins
    with ``seq``: a combinable aggregate, no window, hot keys pre-aggregate
    map-side).  Rows without a position have no place in the order; equal
    positions are ordered by the other columns, so the choice doesn't depend
    on the run."""
    others = [c for c in rows.columns if c not in (key, seq)]
    return (rows.where(F.col(seq).isNotNull()).groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_r"))
            .select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns]))


def without_position(rows: DataFrame, seq: str) -> DataFrame:
    """The rows that :func:`last_per_key` can't place, with a reason."""
    return rows.where(F.col(seq).isNull()).withColumn("reason", F.lit(f"no {seq}"))


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    return last_per_key(rows.withColumn("_seq", F.lit(0)), key, "_seq").drop("_seq")


def upsert(target: DataFrame, source: DataFrame, key: str, seq: str | None = None) -> dict[str, DataFrame]:
    """Insert new keys, replace all non-key columns of existing ones.

    The source is first reduced to one row per key (last by ``seq``), then
    ``target`` minus source keys (``left_anti``) plus the source rows.
    Source rows without a ``seq`` are ``rejects`` with a reason.
    Written once by the caller (atomically, to a new directory/version).
    """
    rejects = without_position(source, seq) if seq else source.where(F.lit(False)).withColumn("reason", F.lit(""))
    src = last_per_key(source, key, seq) if seq else _one_per_key(source, key)
    src = src.select(*[F.col(f.name).cast(f.dataType) for f in target.schema.fields])
    keys = src.select(F.col(key).alias("_k"))
    kept = target.join(keys, target[key] == keys["_k"], "left_anti")
    existing = src.join(target.select(key), key, "left_semi")
    kinds = (src.join(target.select(key).withColumn("_old", F.lit(True)), key, "left")
             .select(F.when(F.col("_old"), "updated").otherwise("inserted").alias("_kind"))
             .unionByName(rejects.select(F.lit("rejected").alias("_kind"))))
    report = kinds.agg(*[F.count_if(F.col("_kind") == k).cast("bigint").alias(k) for k in ("inserted", "updated", "rejected")])
    return {"target": kept.unionByName(src), "updated": existing.select(key), "rejects": rejects, "report": report}


# ---------------------------------------------------------------------------
# Guarded stock deltas
# ---------------------------------------------------------------------------

_FOLD_SCHEMA = "product_id long, seq long, delta long, applied boolean, stock_after long, nth long, whole boolean"


def _guarded_fold(batches):
    """Stream items sorted by product and order; a delta applies only if stock
    stays >= 0, a whole run always.  State is one product at a time: memory
    does not grow with the number of items of a product."""
    import numpy as np
    import pandas as pd
    cur_pid, cur, nth = None, 0, 0
    for pdf in batches:
        pids, base, deltas, whole = (pdf[c].to_numpy() for c in ("product_id", "_stock0", "delta", "_whole"))
        applied = np.zeros(len(pdf), dtype=bool)
        after = np.zeros(len(pdf), dtype=np.int64)
        places = np.zeros(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            if pids[i] != cur_pid:
                cur_pid, cur, nth = pids[i], int(base[i]), 0
            nxt = cur + int(deltas[i])
            if whole[i] or nxt >= 0:
                cur, applied[i] = nxt, True
            after[i], places[i] = cur, nth
            nth += 1
        yield pd.DataFrame({"product_id": pids, "seq": pdf["seq"], "delta": deltas,
                            "applied": applied, "stock_after": after, "nth": places, "whole": whole})


def stock_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cut each product's deltas, in order, into blocks; tell the safe ones.

    ``rows``: (product_id, seq, delta, _stock0).  Returns the rows with their
    block ``(_pid, _blk)`` and place ``_row``, and one summary a block: sum,
    ``_safe`` and ``_risky_before`` (risky blocks up to and with this one).

    The rows are sorted over all partitions, so a product with very many
    deltas lies in many.  With P_k the sum of a product's first k deltas,
    L_k = P_k + max(stock, -min(P_1..P_k)) never exceeds the guarded stock:
    a skipped delta leaves the guarded stock where it is and the bound at 0.
    So a block whose lowest prefix sum stays >= 0 above the bound at its
    start applies as a whole, whatever happened before.  P and its minimum
    come from the blocks' sums and lowest prefixes alone.
    """
    placed = in_blocks(rows.select("product_id", "seq", "delta", "_stock0"), ["product_id", "seq", "delta"], block_rows)
    key = ["product_id", *BLOCK]
    prefix = F.sum("delta").over(Window.partitionBy(*key).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    blocks = placed.withColumn("_prefix", prefix).groupBy(*key).agg(
        F.sum("delta").alias("_sum"), F.min("_prefix").alias("_lowest"), F.first("_stock0").alias("_stock0"))
    # one row a block
    order = Window.partitionBy("product_id").orderBy("_pid", "_blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    blocks = blocks.withColumn("_min", F.min(F.col("_start") + F.col("_lowest")).over(before))
    bound = F.col("_start") + F.greatest(F.col("_stock0"), -F.coalesce("_min", -F.col("_stock0")))
    # below 0 from the start, even an increase may be refused: nothing is known
    blocks = blocks.withColumn("_safe", (F.col("_stock0") >= 0) & (bound + F.col("_lowest") >= 0))
    blocks = blocks.withColumn("_risky_before", F.sum(F.when(F.col("_safe"), 0).otherwise(1))
                               .over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed, blocks.select(*key, "_stock0", "_sum", "_safe", "_risky_before")


def _fold_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Decisions of all ``rows`` and the final stock of their products: safe
    blocks as wholes, only the rows of risky blocks one by one."""
    key = ["product_id", *BLOCK]
    placed, blocks = stock_blocks(rows, block_rows)
    marked = placed.join(blocks.select(*key, "_safe", "_risky_before"), key)
    opened = marked.filter(~F.col("_safe")).select(
        "product_id", "_stock0", "_risky_before", F.lit(0).alias("_run"), "_pid", "_row", "seq", "delta", F.lit(False).alias("_whole"))
    # the safe blocks between two risky ones are one item
    runs = blocks.filter("_safe").groupBy("product_id", "_risky_before").agg(
        F.sum("_sum").alias("delta"), F.first("_stock0").alias("_stock0")).select(
        "product_id", "_stock0", "_risky_before", F.lit(1).alias("_run"), F.lit(0).cast("long").alias("_pid"),
        F.lit(0).cast("long").alias("_row"), F.lit(0).cast("long").alias("seq"), "delta", F.lit(True).alias("_whole"))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    folded = (opened.unionByName(runs).repartition(n, "product_id")
              .sortWithinPartitions("product_id", "_risky_before", "_run", "_pid", "_row")
              .mapInPandas(_guarded_fold, _FOLD_SCHEMA))
    decisions = marked.filter("_safe").select("product_id", "seq", "delta", F.lit(True).alias("applied")).unionByName(
        folded.filter("NOT whole").select("product_id", "seq", "delta", "applied"))
    final = folded.groupBy("product_id").agg(F.max_by("stock_after", "nth").alias("_new"), F.bool_or("applied").alias("_touched"))
    return decisions, final


def apply_stock_deltas(products: DataFrame, deltas: DataFrame, key: str = "product_id",
                       seq: str = "seq", delta: str = "delta",
                       as_of: str | None = None, block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """``stock = stock + delta`` only when the result stays >= 0, in
    ``seq`` order per product (equal ``seq``: by delta).  Deltas of unknown
    products and NULL deltas are not applied.

    Deltas without a ``seq`` have no place and are not applied either.

    Fast path (exact, combinable): if the product's stock plus the sum of
    all its NEGATIVE deltas is >= 0, no guard can ever trigger, so every
    delta applies and the new stock is stock + sum(deltas) -- one
    aggregate, hot products pre-aggregate map-side.
    The other products' deltas are cut into blocks (:func:`stock_blocks`).
    A block that cannot bring the stock below 0 applies as a whole; only
    the rows of the others are folded one by one, in order, by a streaming
    ``mapInPandas`` with O(1) state.  So a product with very many deltas
    is sorted and summed by many tasks, and its one task reads the risky
    blocks' rows alone.

    Returns ``target``, ``decisions`` (per delta: applied) and ``report``.
    """
    d = deltas.select(F.col(key).alias("product_id"), F.col(seq).alias("seq"),
                      F.col(delta).cast("long").alias("delta"))
    p0 = products.select(F.col(key).alias("product_id"), F.col("stock_quantity").cast("long").alias("_stock0"))
    dj = d.join(p0, "product_id", "left")
    unknown = dj.filter(F.col("_stock0").isNull()).select("product_id", "seq", "delta")
    usable = F.col("delta").isNotNull() & F.col("seq").isNotNull()
    no_delta = dj.filter(F.col("_stock0").isNotNull() & ~usable).select("product_id", "seq", "delta")
    known = dj.filter(F.col("_stock0").isNotNull() & usable)
    per = known.groupBy("product_id").agg(
        F.first("_stock0").alias("_stock0"),
        F.sum(F.least(F.col("delta"), F.lit(0))).alias("_neg"),
        F.sum("delta").alias("_sum"))
    fast = per.filter(F.col("_stock0") + F.col("_neg") >= 0)
    slow_ids = per.filter(F.col("_stock0") + F.col("_neg") < 0).select("product_id")
    slow_rows = known.join(slow_ids, "product_id", "left_semi")
    slow_dec, slow_final = _fold_blocks(slow_rows, block_rows)
    fast_final = fast.select("product_id", (F.col("_stock0") + F.col("_sum")).alias("_new"),
                             F.lit(True).alias("_touched"))
    final = fast_final.unionByName(slow_final)
    j = products.join(final.withColumnRenamed("product_id", "_pk"), products[key] == F.col("_pk"), "left")
    changed = F.coalesce(F.col("_touched"), F.lit(False))   # the guarded UPDATE ran at least once
    cols = []
    for f in products.schema.fields:
        if f.name == "stock_quantity":
            cols.append(F.coalesce(F.col("_new"), F.col(f.name)).cast(f.dataType).alias(f.name))
        elif f.name == "updated_at":
            cols.append(F.when(changed, as_of_timestamp(as_of)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    fast_dec = known.join(fast.select("product_id"), "product_id", "left_semi") \
        .select("product_id", "seq", "delta", F.lit(True).alias("applied"))
    decisions = fast_dec.unionByName(slow_dec) \
        .unionByName(unknown.unionByName(no_delta).withColumn("applied", F.lit(False)))
    report = decisions.agg(F.count_if("applied").cast("bigint").alias("applied"),
                           F.count_if(~F.col("applied")).cast("bigint").alias("skipped"))
    return {"target": j.select(*cols), "decisions": decisions, "report": report}
