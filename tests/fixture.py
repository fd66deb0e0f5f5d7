"""A small world: a library of two objects and a target that holds some of their functions.

main calls copy and send; send and recv have the same body but call different functions (copy and pack); copy is long
and unique; twin_a and twin_b cannot be told apart but by what they call.
"""

from fwlens.schema import from_rows

SHIFT = 0x8000000


def leaf(value, slot="value", kind="int"):
    return {"path": f"0.{slot}", "slot": slot, "ctype": kind, "value": str(value)}


def body(function, blocks, edges, calls):
    """blocks: {addr: (tags, operations, constants)}, the first is the start; edges: (src, dst); calls: {addr: [target]}."""
    return {"function": function, "blocks": blocks, "edges": edges, "calls": calls}


def code(seed, n):
    return ([f"Ist_{k}" for k in ("Put", "WrTmp", "Store", "Exit")[: 1 + seed % 4]] + ["Ist_Put"] * n, ["Iop_Add32"] * (1 + seed % 3), [seed])


LIB = {
    "lib_a.o": [
        body((0x100, "copy"), {0x100: code(1, 4), 0x110: code(2, 1), 0x120: code(3, 2)}, [(0x100, 0x110), (0x110, 0x110), (0x110, 0x120)], {}),
        body((0x200, "pack"), {0x200: code(4, 3), 0x210: code(5, 1)}, [(0x200, 0x210)], {}),
        body((0x300, "send"), {0x300: code(6, 2), 0x310: code(7, 1)}, [(0x300, 0x310)], {0x300: [0x100]}),
        body((0x400, "recv"), {0x400: code(6, 2), 0x410: code(7, 1)}, [(0x400, 0x410)], {0x400: [0x200]}),
        body((0x500, "tiny"), {0x500: code(1, 0)}, [], {}),
    ],
    "lib_b.o": [body((0x600, "main"), {0x600: code(8, 2), 0x610: code(9, 2), 0x620: code(10, 1)}, [(0x600, 0x610), (0x610, 0x620)], {0x600: [0x700], 0x610: [0x710]})],
}
STUBS = {"lib_b.o": {0x700: "copy", 0x710: "helper"}}


def moved(b, by, names=True, constant=None):
    blocks = {a + by: (t, o, c if constant is None else [constant]) for a, (t, o, c) in b["blocks"].items()}
    return body((b["function"][0] + by, b["function"][1] if names else f"f_{b['function'][0]:x}"), blocks, [(x + by, y + by) for x, y in b["edges"]], {a + by: [t + by for t in ts] for a, ts in b["calls"].items()})


def world(spark):
    rows = {k: [] for k in ("objects", "regions", "symbols", "functions", "cfg_nodes", "statements", "cfg_edges", "call_sites", "callgraph", "hooks")}

    def add(object_id, library, role, functions, low, high, stubs=None):
        rows["objects"].append((object_id, library, f"/libs/{library}/{object_id}", role, "ARMCortexM", low, high, low, functions[0]["function"][0]))
        rows["regions"].append((object_id, "segment", ".text", low, high))
        n = 0
        for f in functions:
            addr, name = f["function"]
            rows["functions"].append((object_id, addr, name, addr, False, False, False))
            rows["symbols"].append((object_id, n, False, name, addr, 16, "STB_GLOBAL", True, False, False))
            n += 1
            for k, (a, (tags, ops, consts)) in enumerate(f["blocks"].items()):
                jump = "Ijk_Call" if a in f["calls"] else "Ijk_Boring"
                count = len(tags)
                rows["cfg_nodes"].append((object_id, addr, a, k, 4 * count, jump, True, 1, [a + 4 * i for i in range(count)], tags, ops, [8], consts))
                for i, t in enumerate(tags):
                    rows["statements"].append((object_id, addr, a, 0, i, t, [leaf(consts[0])] if i == 0 else [leaf(i, "offset")]))
                for i, target in enumerate(f["calls"].get(a, [])):
                    rows["call_sites"].append((object_id, addr, a, k, i, target))
                    rows["callgraph"].append((object_id, addr, target))
            rows["cfg_edges"] += [(object_id, addr, a, b, "transition") for a, b in f["edges"]]
        for addr, name in (stubs or {}).items():
            rows["functions"].append((object_id, addr, name, addr, True, False, False))
            rows["symbols"].append((object_id, n, True, name, addr, 0, "STB_GLOBAL", True, False, False))
            n += 1

    for object_id, functions in LIB.items():
        add(object_id, "hal", "lib", functions, 0, 0x1000, STUBS.get(object_id))
    a, b = LIB["lib_a.o"], LIB["lib_b.o"]
    image = [moved(f, SHIFT) for f in a if f["function"][1] != "recv"]
    main = moved(b[0], SHIFT)
    main["calls"] = {0x600 + SHIFT: [0x100 + SHIFT], 0x610 + SHIFT: [0x900 + SHIFT]}
    helper = body((0x900 + SHIFT, "helper"), {0x900 + SHIFT: code(30, 9), 0x910 + SHIFT: code(31, 1)}, [(0x900 + SHIFT, 0x910 + SHIFT)], {})
    add("image", "-", "target", [*image, main, helper], SHIFT, SHIFT + 0x1000)
    return from_rows(spark, rows)
