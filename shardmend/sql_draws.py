"""Pieces of SQL that the twins of seeded queries share."""

from __future__ import annotations

#: The odd increments of the streams that steps and chip keys draw from.
STEP_INCREMENT, KEY_INCREMENT = 2493549199, 15


def draws(name: str, rows: str, limit: str, increment: int = STEP_INCREMENT, seed: str = "doc_id") -> str:
    """CTEs that end in ``name``: (doc_id, v), the first ``limit`` draws of each row of ``rows`` (doc_id and what the expressions name)."""
    step = f"(st * 6364136223846793005::UHUGEINT + {increment}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    first = f"(({increment}::UHUGEINT + ({seed})::UHUGEINT) % 18446744073709551616::UHUGEINT * 6364136223846793005::UHUGEINT + {increment}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    value = "(((x >> r) | ((x::UHUGEINT * (1::UHUGEINT << ((32::UBIGINT - r) % 32::UBIGINT)::UHUGEINT)) % 4294967296::UHUGEINT)::UBIGINT) & 4294967295::UBIGINT)::BIGINT"
    return f"""
        {name}_g AS (SELECT doc_id, 0 AS i, ({limit})::BIGINT AS most, {first} AS st FROM {rows} UNION ALL SELECT doc_id, i + 1, most, {step} FROM {name}_g WHERE i + 1 < most),
        {name}_o AS (SELECT doc_id, i, most, (xor(st::UBIGINT >> 18::UBIGINT, st::UBIGINT) >> 27::UBIGINT) & 4294967295::UBIGINT AS x, st::UBIGINT >> 59::UBIGINT AS r FROM {name}_g),
        {name} AS (SELECT doc_id, list({value} ORDER BY i) AS v FROM {name}_o WHERE i < most GROUP BY doc_id)"""


PAYLOAD = "p AS (SELECT doc_id, octet_length(encode(text)) AS n, upper(hex(encode(text))) AS hx FROM documents)"


def digest(ctes: str, hexed: str, of: str) -> str:
    """A twin of a seeded query: ``hexed`` is the result in hex, of rows ``of`` with doc_id, n and hx."""
    return f"WITH RECURSIVE {PAYLOAD}, {ctes}, r AS (SELECT doc_id, n, {hexed} AS h FROM {of}) SELECT doc_id, n::INTEGER AS n_in, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r"


def by_byte(expression: str) -> str:
    """Hex of a payload whose k-th byte (from 0) becomes a hex pair by an expression of k."""
    return f"array_to_string(list_transform(range(n), lambda k: {expression}), '')"


OWN = "substr(hx, (2 * k + 1)::BIGINT, 2)"


def share(percent: float) -> str:
    return f"CAST(floor(n * {float(percent)}::DOUBLE / 100) AS BIGINT)"


def sorted_places(count: int, low: str, high: str) -> str:
    """Sorted places in [low, high) from the first draws ``v``; none where the range is empty."""
    return f"CASE WHEN {high} > {low} THEN list_sort(list_transform(v[1:{count}], lambda x: {low} + x % ({high} - {low}))) ELSE [] END"


def flipped(name: str, rows: str, rate: float, seed: str) -> str:
    """CTEs that end in ``name``: (doc_id, n, hx) of ``rows`` with about ``rate`` flipped bits in 100 KB, at least one."""
    q = draws(f"{name}_v", f"{name}_e", "CASE WHEN n = 0 THEN 1 ELSE 3 + 2 * floor(want) END", seed=seed)
    bits = "xor(('0x' || bx[k + 1])::BIGINT, list_reduce(list_transform(list_filter(t, lambda y: y // 256 = k), lambda y: y % 256), lambda c, d: xor(c, d)))"
    changed = by_byte(f"CASE WHEN list_contains(s, k) THEN format('{{:02X}}', {bits}) ELSE bx[k + 1] END")
    return f"""{name}_e AS MATERIALIZED (SELECT doc_id, n, hx, n * {float(rate)}::DOUBLE / 102400 AS want FROM {rows}), {q},
        {name}_f AS (SELECT e.doc_id, n, hx, v, greatest(1, floor(want)::BIGINT + CASE WHEN v[1] / 4294967296.0::DOUBLE < want - floor(want) THEN 1 ELSE 0 END) AS m FROM {name}_e e JOIN {name}_v ON {name}_v.doc_id = e.doc_id),
        {name}_s AS (SELECT *, CASE WHEN n > 0 THEN list_sort(list_transform(v[2:m + 1], lambda x: x % n)) ELSE [] END AS s FROM {name}_f),
        {name}_t AS MATERIALIZED (SELECT *, regexp_extract_all(hx, '..') AS bx, list_transform(range(1, len(s) + 1), lambda j: s[j] * 256 + (1::BIGINT << (v[1 + m + j] % 8))) AS t FROM {name}_s),
        {name} AS MATERIALIZED (SELECT doc_id, n, {changed} AS hx FROM {name}_t)"""


def twins() -> dict[str, str]:
    """SQL of the seeded queries, by step. Draws that a uniform range throws away are rarer than one in a million and left out."""
    out = {}
    a, b = share(20), share(80)
    q = draws("g", "p", "3")
    cut = lambda h, i: f"CASE WHEN len(s) >= {i} THEN substr({h}, 1, 2 * s[{i}]) || substr({h}, 2 * (s[{i}] + 5) + 1) ELSE {h} END"
    out["byte_delete"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, {sorted_places(3, a, b)} AS s FROM p JOIN g USING (doc_id)), s3 AS (SELECT *, {cut('hx', 3)} AS h3 FROM s), s2 AS (SELECT *, {cut('h3', 2)} AS h2 FROM s3)", cut("h2", 1), "s2")
    q = draws("g", "p", "10")
    put = lambda h, i, at: f"CASE WHEN len(s) >= {i} THEN substr({h}, 1, 2 * s[{i}]) || array_to_string(list_transform(v[{at}:{at + 3}], lambda x: format('{{:02X}}', x & 255)), '') || substr({h}, 2 * s[{i}] + 1) ELSE {h} END"
    out["byte_insert"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, v, {sorted_places(2, a, b)} AS s FROM p JOIN g USING (doc_id)), s2 AS (SELECT *, {put('hx', 2, 3)} AS h2 FROM s)", put("h2", 1, 7), "s2")
    q, a, b = draws("g", "p", "6"), share(10), share(90)
    mark = lambda h, i, at: f"CASE WHEN len(s) >= {i} THEN substr({h}, 1, 2 * s[{i}]) || 'FF' || format('{{:02X}}', 208 + v[{at}] % 8) || substr({h}, 2 * s[{i}] + 1) ELSE {h} END"
    out["fake_marker"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, v, {sorted_places(3, a, b)} AS s FROM p JOIN g USING (doc_id)), s3 AS (SELECT *, {mark('hx', 3, 4)} AS h3 FROM s), s2 AS (SELECT *, {mark('h3', 2, 5)} AS h2 FROM s3)", mark("h2", 1, 6), "s2")
    q = draws("g", "p", "3")
    out["zero_run"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, {sorted_places(3, '0', 'n')} AS s FROM p JOIN g USING (doc_id))", by_byte(f"CASE WHEN len(list_filter(s, lambda x: k >= x AND k < x + 64)) > 0 THEN '00' ELSE {OWN} END"), "s")
    q = draws("g", "p", "greatest(1, (least(n, 1024) + 3) // 4)")
    key = "xor(('0x' || substr(hx, (2 * k + 1)::BIGINT, 2))::BIGINT, (v[k // 4 + 1] >> (8 * (k % 4))) & 255)"
    out["ransomware"] = digest(f"{q}, s AS (SELECT * FROM p JOIN g USING (doc_id))", by_byte(f"CASE WHEN k < 1024 THEN format('{{:02X}}', {key}) ELSE {OWN} END"), "s")
    q = "e AS (SELECT *, n * 200.0::DOUBLE / 102400 AS want FROM p), " + draws("g", "e", "CASE WHEN n = 0 THEN 1 ELSE 3 + 2 * floor(want) END")
    flips = f"{q}, f AS (SELECT doc_id, n, hx, v, greatest(1, floor(want)::BIGINT + CASE WHEN v[1] / 4294967296.0::DOUBLE < want - floor(want) THEN 1 ELSE 0 END) AS m FROM e JOIN g USING (doc_id)), s AS (SELECT *, CASE WHEN n > 0 THEN list_sort(list_transform(v[2:m + 1], lambda x: x % n)) ELSE [] END AS s FROM f), t AS (SELECT *, list_transform(range(1, len(s) + 1), lambda j: s[j] * 256 + (1::BIGINT << (v[1 + m + j] % 8))) AS t FROM s)"
    flipped = "xor(('0x' || substr(hx, (2 * k + 1)::BIGINT, 2))::BIGINT, list_reduce(list_transform(list_filter(t, lambda y: y // 256 = k), lambda y: y % 256), lambda c, d: xor(c, d)))"
    out["bitflip"] = digest(flips, by_byte(f"CASE WHEN list_contains(s, k) THEN format('{{:02X}}', {flipped}) ELSE {OWN} END"), "t")
    q = draws("g", "p", "6")
    steps, last = f"{q}, d0 AS (SELECT doc_id, n, hx, v, hx AS h, least(n, 624) AS a, greatest(n - least(n, 624), 0) // 512 AS c FROM p JOIN g USING (doc_id))", "d0"
    for i in range(6):
        at = f"(a + v[{i + 1}] % (c - {i}) * 512)"
        steps += f", d{i + 1} AS (SELECT * REPLACE (CASE WHEN c - {i} < 2 THEN h ELSE substr(h, 1, 2 * {at}) || substr(h, 2 * {at} + 1025) END AS h) FROM {last})"
        last = f"d{i + 1}"
    out["dropped_sectors"] = digest(steps, "h", last)
    q = draws("g", "p", "2")
    steps, last = f"{q}, d0 AS (SELECT doc_id, n, hx, v, hx AS h, least(n, 624) AS a, greatest(n - least(n, 624), 0) // 1024 AS c FROM p JOIN g USING (doc_id))", "d0"
    for i in range(2):
        at = f"(a + v[{i + 1}] % (c + {i}) * 1024)"
        steps += f", d{i + 1} AS (SELECT * REPLACE (CASE WHEN c < 2 THEN h ELSE substr(h, 1, 2 * {at} + 2048) || substr(h, 2 * {at} + 1) END AS h) FROM {last})"
        last = f"d{i + 1}"
    out["stutter_read"] = digest(steps, "h", last)
    q = draws("g", "p", "3")
    fill = "".join(f"{x:02X}" for x in b"BAD SECTOR ")
    cases = " ".join(f"WHEN k >= s[{j}] AND k < s[{j}] + 4096 THEN substr('{fill}', 2 * ((k - s[{j}]) % 11)::BIGINT + 1, 2)" for j in (3, 2, 1))
    out["tool_fill_pattern"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, CASE WHEN n - least(n, 624) >= 512 THEN list_transform(v, lambda x: least(n, 624) + x % ((n - least(n, 624)) // 512) * 512) ELSE [] END AS s FROM p JOIN g USING (doc_id))", by_byte(f"CASE WHEN len(s) = 0 THEN {OWN} {cases} ELSE {OWN} END"), "s")
    q = draws("g", "p", "2")
    out["flash_zero"] = digest(f"{q}, s AS (SELECT doc_id, n, hx, CASE WHEN n - least(n, 624) >= 2048 THEN list_transform(v, lambda x: least(n, 624) + x % ((n - least(n, 624)) // 2048 + 1) * 2048) ELSE [] END AS s FROM p JOIN g USING (doc_id))", by_byte(f"CASE WHEN len(list_filter(s, lambda x: k >= x AND k < x + 2048)) > 0 THEN '00' ELSE {OWN} END"), "s")
    start = "(least(n, 624) + floor((n - least(n, 624)) * 40.0::DOUBLE / 100)::BIGINT)"
    q = f"e AS (SELECT *, {start} AS a FROM p), " + draws("g", "e", "greatest(1, (n - a + 2047) // 2048)") + ", " + draws("y", "p", "512", KEY_INCREMENT, "xor(1548368670::BIGINT, doc_id)")
    mixed = "xor(('0x' || substr(hx, (2 * k + 1)::BIGINT, 2))::BIGINT, y[((k - a) % 2048) % 512 + 1] & 255)"
    out["chipoff_xor"] = digest(f"{q}, s AS (SELECT e.doc_id, n, hx, a, g.v AS v, y.v AS y FROM e JOIN g ON g.doc_id = e.doc_id JOIN y ON y.doc_id = e.doc_id)", by_byte(f"CASE WHEN k >= a AND v[((k - a) // 2048 + 1)::BIGINT] / 4294967296.0::DOUBLE < 0.3 THEN format('{{:02X}}', {mixed}) ELSE {OWN} END"), "s")
    q = draws("g", "p", "1")
    size = "least(greatest(floor(n * 0.5::DOUBLE + 0.5)::BIGINT, 1), n)"
    out["ftp_stretch"] = digest(f"{q}, e AS (SELECT doc_id, n, hx, v, {size} AS size FROM p JOIN g USING (doc_id)), s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE v[1] % (n - size + 1) END AS low FROM e)", by_byte(f"CASE WHEN {OWN} = '0A' AND k >= low AND k < low + size AND (k = 0 OR substr(hx, (2 * k - 1)::BIGINT, 2) <> '0D') THEN '0D0A' ELSE {OWN} END"), "s")
    q = draws("g", "p", "2")
    lines = "(len(e) + 75) // 76"
    out["base64_damage"] = digest(
        f"{q}, e AS (SELECT p.doc_id, n, hx, v, to_base64(unhex(hx)) AS e FROM p JOIN g ON g.doc_id = p.doc_id), s AS (SELECT *, {lines} AS m, CASE WHEN {lines} > 1 THEN list_transform(v, lambda x: 1 + x % ({lines} - 1)) ELSE [] END AS s FROM e),"
        " t AS (SELECT *, replace(array_to_string(list_transform(list_filter(range(m), lambda i: NOT list_contains(s, i)), lambda i: substr(e, 76 * i + 1, 76)), ''), '=', '') AS t FROM s), u AS (SELECT *, substr(t, 1, len(t) - CASE WHEN len(t) % 4 = 1 THEN 1 ELSE 0 END) AS u FROM t)",
        "CASE WHEN m < 2 THEN hx ELSE upper(hex(from_base64(u || repeat('=', ((4 - len(u) % 4) % 4)::BIGINT)))) END", "u",
    )
    # Two pages: the number of one, the length and place of its burst, the bytes; an empty page takes no more draws.
    q = draws("g", "p", "CASE WHEN n - least(n, 624) < 2048 THEN 1 ELSE 1156 END")
    steps, last = f"{q}, b0 AS (SELECT p.doc_id, n, hx, v, hx AS h, 1::BIGINT AS j, least(n, 624) AS a, (n - least(n, 624)) // 2048 AS c FROM p JOIN g ON g.doc_id = p.doc_id)", "b0"
    for i in range(2):
        steps += f""", k{i} AS (SELECT *, a + v[j] % (c + 1) * 2048 AS k, least(2048, n - (a + v[j] % (c + 1) * 2048)) AS size FROM {last}),
            m{i} AS (SELECT *, CASE WHEN c > 0 AND size > 0 THEN least(v[j + 1] % 512 + 64, size) ELSE 0 END AS m FROM k{i}),
            b{i + 1} AS (SELECT doc_id, n, hx, v, CASE WHEN m = 0 THEN h ELSE substr(h, 1, 2 * (k + v[j + 2] % (size - m + 1))) || array_to_string(list_transform(v[j + 3:j + 2 + m], lambda x: format('{{:02X}}', x & 255)), '') || substr(h, 2 * (k + v[j + 2] % (size - m + 1) + m) + 1) END AS h,
                          j + CASE WHEN m > 0 THEN 3 + m ELSE 1 END AS j, a, c FROM m{i})"""
        last = f"b{i + 1}"
    out["flash_fault"] = digest(steps, "h", last)
    return out
