"""Line-by-line statements of the rules, to test the distributed forms against."""

import re


def chunks(lines, kind, start=None, end=None, separator=None, only_last=False):
    """[(offset, physical index of first line, lines)]"""
    found = []
    if kind == "marker" and start:
        for i, line in enumerate(lines):
            fresh = bool(re.search(start, line)) or not found or closed
            if fresh:
                found.append((i, [line]))
            else:
                found[-1][1].append(line)
            closed = bool(end and re.search(end, line) and not re.search(start, line))
    elif kind == "separator" and separator:
        apart = True
        for i, line in enumerate(lines):
            if re.search(separator, line):
                apart = True
                if only_last:
                    found = []
            else:
                if apart:
                    found.append((i, []))
                found[-1][1].append(line)
                apart = False
    elif lines:
        found = [(0, list(lines))]
    out, offset = [], 0
    for first, body in found:
        out.append((offset, first, body))
        offset += len(body)
    return out[-1:] if only_last else out


def last_run(body, markers):
    at = [i for i, line in enumerate(body) if any(m.search(line) for m in markers)]
    return at[-1] if at else 0


def excerpt(lines, first, run, body, at, prefix, suffix, limit, compat=False):
    """`first`: physical index of the chunk, `run`: start of the last run in it, `at`: index in the chunk."""
    before = body[max(run, at - prefix):at]
    lacking = max(0, prefix - len(before))
    if compat and lacking == 0:
        lacking = prefix
    borrowed = lines[max(0, first - lacking):first]
    whole = borrowed + before + body[at:at + 1 + suffix]
    m = len(borrowed) + len(before)
    limit = max(1, limit)
    if len(whole) > limit:
        begin = max(0, m - limit // 2)
        begin = min(begin, len(whole) - limit)
        whole = whole[begin:begin + limit]
    return whole


def findings(lines, errors=(), warnings=(), ignores=(), prefix=0, suffix=0, limit=20, compat=False, markers=None,
             kind="whole_file", **grouping):
    out = []
    for offset, first, body in chunks(lines, kind, **grouping):
        run = last_run(body, markers) if markers is not None else 0
        for at in range(run, len(body)):
            line = body[at]
            if any(re.search(p, line, re.I) for p in ignores):
                continue
            for severity, patterns in (("ERROR", errors), ("WARNING", warnings)):
                for p in patterns:
                    for m in re.finditer(p, line, re.I):
                        out.append((len(out), severity, p, m.group(0), offset + at + 1, excerpt(
                            lines, first, run, body, at, prefix, suffix, limit, compat)))
    return out
