"""Bounded text for callers that read and pay by the character."""

from __future__ import annotations

MAX_CELL, MAX_CHARS = 40, 12_000


def _text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, list):
        return ",".join(map(_text, v))
    return str(v)


def rows_text(rows: list[dict], max_cell: int = MAX_CELL) -> str:
    """A table: first column left, others right, long cells cut by an ellipsis."""
    if not rows:
        return "(no rows)"
    cols = list(rows[0])
    cells = [[_text(r.get(c)) for c in cols] for r in rows]
    width = [min(max_cell, max(len(c), *(len(r[i]) for r in cells))) for i, c in enumerate(cols)]
    line = lambda r: "  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(r, width, strict=True)))
    short = lambda s: s if len(s) <= max_cell else s[: max_cell - 1] + "…"
    return "\n".join([line(cols), line(["-" * w for w in width]), *(line([short(x) for x in r]) for r in cells)])


def envelope_text(env: dict) -> str:
    last = env["offset"] + env["returned"]
    more = f"; more from offset {last}" if env["truncated"] else ""
    return f"rows {env['offset'] + 1 if env['returned'] else 0}-{last} of {env['total']}{more}"


def within_budget(header: str, rows: list[str], footer: str, max_chars: int = MAX_CHARS) -> tuple[str, int]:
    """Whole trailing rows go until the text fits; how many is said in it."""
    left = max_chars - (len(header) + len(footer) + len(rows) + 8)
    kept = 0
    for r in rows:
        if len(r) + 1 > left:
            break
        left -= len(r) + 1
        kept += 1
    dropped = len(rows) - kept
    notice = f"\n({dropped} more row(s) don't fit into {max_chars} characters: ask for fewer rows or columns)" if dropped else ""
    return header + "\n" + "\n".join(rows[:kept]) + notice + "\n" + footer, dropped


def table_within_budget(env: dict, max_chars: int = MAX_CHARS) -> tuple[str, int]:
    lines = rows_text(env["items"]).split("\n")
    return within_budget("\n".join(lines[:2]), lines[2:], envelope_text(env), max_chars)


def waterfall(transactions: list[dict], width: int = 40) -> str:
    """One bar a transaction on a common time axis."""
    if not transactions:
        return "(no transactions)"
    begin = min(t["request_time_ms"] for t in transactions)
    end = max(t["response_time_ms"] if t["response_time_ms"] is not None else t["request_time_ms"] for t in transactions)
    scale = (width - 1) / (end - begin) if end > begin else 0
    out = []
    for t in transactions:
        a = int((t["request_time_ms"] - begin) * scale)
        z = int(((t["response_time_ms"] if t["response_time_ms"] is not None else t["request_time_ms"]) - begin) * scale)
        bar = " " * a + ("█" * (z - a + 1) if t["response_time_ms"] is not None else "?")
        out.append(f"{bar.ljust(width)} {t['method'] or ''} {t['uri'] or ''} → {_text(t['status_code'])} {_text(t['resp_time_ms'])} ms")
    return "\n".join(out)


# --- one for each tool: (header, rows, footer) ---


def _pick(rows: list[dict], **cols) -> list[str]:
    return rows_text([{n: (c(r) if callable(c) else r.get(c)) for n, c in cols.items()} for r in rows]).split("\n")


def _end(ip, port) -> str:
    return f"{ip}:{_text(port) if port is not None else ''}" if ip else ""


def show_open(out: dict) -> tuple[str, list[str], str]:
    return "capture", [f"{k}: {_text(v)}" for k, v in out["capture"].items()], "overview next"


def show_overview(out: dict) -> tuple[str, list[str], str]:
    c, n = out["capture"], out["conversation_counts"]
    tree = [f"{'  ' * p['depth']}{p['protocol']}  {p['frames']} frames, {p['bytes']} bytes" for p in out["protocol_distribution"]]
    both = lambda a, b: lambda r: r[a] + r[b]
    top = _pick(out["top_conversations_by_bytes"], transport="transport", a="a", b="b", frames=both("frames_a_to_b", "frames_b_to_a"), bytes=both("bytes_a_to_b", "bytes_b_to_a"), start_s="relative_start_s")
    head = f"{c['capture_id']}: {_text(c.get('packet_count'))} packets in {_text(c.get('duration_ms'))} ms; {n['tcp']} TCP and {n['udp']} UDP conversations"
    return head, ["largest conversations", *top, f"protocols ({len(tree)} of {out['protocol_paths']} paths)", *tree], "query or inspect a conversation next"


def show_query(out: dict) -> tuple[str, list[str], str]:
    return envelope_text(out["result"]), rows_text(out["result"]["items"]).split("\n"), ""


def show_inspect(out: dict) -> tuple[str, list[str], str]:
    c, again, line = out["conversation"], out["aggregates"]["retransmissions"]["evidence"], out["timeline"]
    metrics = ", ".join(f"{k} {_text(v)}" for k, v in c.items() if k.endswith(("_count", "_ms", "_bps", "_bytes")) and v is not None)
    head = [
        f"{c['conversation_id']}  {_end(c['initiator_ip'], c['initiator_port'])} to {_end(c['responder_ip'], c['responder_port'])}  {'+'.join(c['protocol_tags'])}  (direction by {c['direction_basis']})",
        f"packets {c['packets_forward']} out, {c['packets_reverse']} back; bytes {c['bytes_forward']} out, {c['bytes_reverse']} back", metrics,
        f"retransmitted in frames {_text(again['frames'])}{' and more' if again['truncated'] else ''} ({again['frame_count']})", f"timeline: {envelope_text(line)}",
    ]
    way = {"initiator_to_responder": "out", "responder_to_initiator": "back"}
    return "\n".join(head), _pick(line["items"], time_ms="time_ms", type="type", way=lambda e: way.get(e["direction"], "?"), frame="frame_number"), ""


def show_evidence(out: dict) -> tuple[str, list[str], str]:
    lost = f"; not in the capture: {_text(out['missing_frames'])}" if out["missing_frames"] else ""
    head = f"{out['returned']} records for {out['requested']} frames{' (more than fit)' if out['truncated'] else ''}{lost}"
    rows = _pick(
        out["frames"], frame="frame_number", time_ms="time_ms", src=lambda f: _end(f["ip_src"], f["src_port"]), dst=lambda f: _end(f["ip_dst"], f["dst_port"]), flags="tcp_flags", seq="tcp_seq_raw", ack="tcp_ack_raw",
        len="tcp_len", window="tcp_window", rtt_ms="ack_rtt_ms", analysis="analysis", info="info",
    )
    return head, rows, "claims should agree with these records"


def show_timeseries(out: dict) -> tuple[str, list[str], str]:
    wider = f", widened from {_text(out['requested_bin_ms'])}" if out["sampled"] else ""
    return f"{out['metric']} of {out['conversation_id']}: {out['bins_count']} bins of {_text(out['bin_ms'])} ms{wider}", rows_text(out["bins"]).split("\n"), ""


def show_http_timeline(out: dict) -> tuple[str, list[str], str]:
    where = f" of {out['conversation_id']}" if out["conversation_id"] else ""
    return f"HTTP transactions{where}: {envelope_text(out)}; {out['unmatched_requests']} unanswered", waterfall(out["transactions"]).split("\n"), "only unencrypted HTTP is seen"


def show_sql(out: dict) -> tuple[str, list[str], str]:
    return f"{out['row_count']} rows{' (there are more)' if out['truncated'] else ''} in {out['elapsed_ms']} ms: {', '.join(out['columns'])}", rows_text(out["rows"]).split("\n"), "schema lists tables and columns"


def show_schema(out: dict) -> tuple[str, list[str], str]:
    lines = []
    for t in out["tables"]:
        lines.append(f"{t['name']} ({t['kind']}, {_text(t['row_count'])} rows; evidence: {t['evidence']}): {t['description']}")
        lines += [f"  {c['name']} {c['type']}: {c['description']}{'; null: ' + c['null'] if c['null'] else ''}" for c in t["columns"]]
    return "tables for read-only SELECT", lines, ""


def show_raw_query(out: dict) -> tuple[str, list[str], str]:
    flt = out["audit"].get("display_filter") or out.get("display_filter")
    return f"{out['returned']} rows{' (there are more)' if out['truncated'] else ''}{' where ' + flt if flt else ''}", rows_text(out["rows"]).split("\n"), f"fields: {', '.join(out['fields'])}"
