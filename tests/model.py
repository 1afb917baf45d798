"""A sequential model of grouping and numbering, one file after the other, to hold the plan against."""


def split(name):
    ext = name.rpartition(".")[2] if "." in name else ""
    suffix = "." + ext
    return (name[: -len(suffix)] if name.endswith(suffix) and name != suffix else name), ext


def target_dir(directory, source, target):
    return (target + "/" + directory.replace(source, "").strip("/")).rstrip("/")


def rename(files, new_name, key, existing, source, target, own_ext=False):
    """files: (path, content); the plan as {path: (target, idx, number)}."""
    groups = {}
    for path, content in sorted(files):
        directory, _, filename = path.rpartition("/")
        name = new_name(filename)
        if name is None:
            continue
        k = key(target_dir(directory, source, target) + "/" + name, name, content)
        if k is not None:
            groups.setdefault(k, (name, []))[1].append(path)
    plan = {}
    for name, paths in groups.values():
        stem, ext = split(name)
        rows = []
        for path in paths:
            directory, _, filename = path.rpartition("/")
            rows.append((path, target_dir(directory, source, target), split(filename)[1] if own_ext else ext))
        for i, (path, d, e) in enumerate(rows):
            if path == f"{d}/{stem}.{e}":
                del rows[i]
                break
        count = 1
        for idx, (path, d, e) in enumerate(rows):
            to, number = f"{d}/{stem}.{e}", None
            if to in existing:
                while True:
                    to, number = f"{d}/{stem}-duplicate-{count:03d}.{e}", count
                    count += 1
                    if to not in existing:
                        break
            elif idx > 0:
                to, number = f"{d}/{stem}-duplicate-{count:03d}.{e}", count
                count += 1
            plan[path] = (to, idx, number)
    return plan
