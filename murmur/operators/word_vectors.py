"""Vectors of words in Arrow batches: what stands around a word, the vectors of groups, cosines of candidates (K2 by vectors).

A vector holds whole numbers until it is scaled, so it travels as such: as
counts by word while it is added up, in the smallest type that holds it
afterwards.  No row holds scaled vectors but the sums of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens, or asked words, that a task adds up at once; cells of its table of counts; rows and entries handled at once.
TOKENS, CELLS, ROWS, ENTRIES = 4_000_000, 1 << 24, 20_000, 50_000
#: A count up to this is written as so many single marks.
FEW = 4
#: An entry of ``tf`` or ``wide`` is a group times this plus a count; ``wide`` has what 32 bits cannot hold.
SHIFT, WIDE_SHIFT = 1 << 7, 1 << 31

INTS, LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
NOTES = pa.schema([("language", pa.string()), ("word", pa.string()), ("few", pa.binary()), ("many", INTS), ("tf", INTS), ("wide", LONGS), ("days", INTS)])
NOTES_DDL = "language string, word string, few binary, many array<int>, tf array<int>, wide array<bigint>, days array<int>"
CUT = pa.schema([("date", pa.date32()), ("language", pa.string()), ("terms", pa.binary())])
CUT_DDL = "date date, language string, terms binary"
PARTS = pa.schema([("date", pa.date32()), ("language", pa.string()), ("emotion", pa.int32()), ("word", pa.string()), ("few", pa.binary()), ("x", pa.binary())])
PARTS_DDL = "date date, language string, emotion int, word string, few binary, x binary"


def _ints(a: pa.Array, none: int = -1) -> np.ndarray:
    return pc.fill_null(a, none).to_numpy(zero_copy_only=False)


def _offsets(of: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)


def _lists(of: np.ndarray, values: np.ndarray, n: int, kind: pa.ListType = INTS) -> pa.ListArray:
    """A list for each of ``n`` words, null without values; ``of`` ascends."""
    offsets = _offsets(of, n)
    none = pa.array(offsets[1:] == offsets[:-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.value_type.to_pandas_dtype())), mask=none)


def _binaries(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _mark(dimensions: int) -> str:
    return "<u1" if dimensions <= 128 else "<u4"


def _coded(parts: list[pa.DictionaryArray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of all parts, and each row's place among them (-1: null)."""
    one = pa.chunked_array(parts).unify_dictionaries()
    return one.chunk(0).dictionary, np.concatenate([_ints(c.indices) for c in one.chunks])


def _sliced(language: str, words: pa.Array, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(words)
    all_ = pa.record_batch([pa.repeat(pa.scalar(language), n), words, *(columns.get(f.name, pa.nulls(n, f.type)) for f in list(NOTES)[2:])], schema=NOTES)
    for k in range(0, len(words), ROWS):
        yield all_.slice(k, ROWS)


def note_words(batches: Iterator[pa.RecordBatch], dimensions: int, reach: int, emotions: list[str]) -> Iterator[pa.RecordBatch]:
    """Comments (date, language, emotion, lemmas, near) to one row per word: what stands around it, and how often each group has it.

    ``near`` holds a word's dimension doubled, plus one if its sign is positive.
    Counts are added up over ``TOKENS`` tokens, so a word's row stands for many comments.
    """
    place = {e: k for k, e in enumerate(emotions)}
    held: dict[str, list] = {}
    tokens = 0
    for batch in batches:
        emotion = batch.column("emotion").dictionary_encode()
        names = np.array([place.get(e, -1) for e in emotion.dictionary.to_pylist()] + [-1])
        e = names[_ints(emotion.indices)]
        day = batch.column("date").cast(pa.int32())
        group = np.where((e < 0) | day.is_null().to_numpy(zero_copy_only=False), -1, 0)
        code = np.where(group < 0, np.iinfo(np.int64).min, _ints(day, 0).astype(np.int64) * max(1, len(emotions)) + e)
        for language in pc.drop_null(batch.column("language").unique()).to_pylist():
            mine = pc.equal(batch.column("language"), language)
            part, at = batch.filter(mine), pc.fill_null(mine, False).to_numpy(zero_copy_only=False)
            lemmas, near = part.column("lemmas"), part.column("near")
            words = lemmas.flatten()
            held.setdefault(language, []).append((words.dictionary_encode(), _ints(near.flatten()).astype(np.int32), _ints(pc.list_value_length(lemmas), 0), code[at]))
            tokens += len(words)
        if tokens >= TOKENS:
            for language in list(held):
                yield from _noted(language, held.pop(language), dimensions, reach)
            tokens = 0
    for language in list(held):
        yield from _noted(language, held.pop(language), dimensions, reach)


def _pieces(of: np.ndarray, d: np.ndarray, x: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts ``x`` of words and dimensions, a very large one as several entries that 32 bits hold."""
    most = (1 << 31) // dimensions - 1
    if not len(x) or np.abs(x).max() <= most:
        return of, d, x
    times = np.maximum(1, -(-np.abs(x) // most))
    rest = x - np.sign(x) * most * (times - 1)
    of, d, x = np.repeat(of, times), np.repeat(d, times), np.repeat(np.sign(x) * most, times)
    x[np.cumsum(times) - 1] = rest
    return of, d, x


def _noted(language: str, parts: list, dimensions: int, reach: int) -> Iterator[pa.RecordBatch]:
    words, ids = _coded([p[0] for p in parts])
    near, lengths, codes = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    n = len(words)
    if not n:
        return
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    step = max(1, CELLS // dimensions)
    found = []
    for low in range(0, n, step):
        high = min(n, low + step)
        sums = np.zeros((high - low) * dimensions, np.int32)
        for k in range(1, reach + 1):
            both = (text[k:] == text[:-k]) & (ids[k:] >= 0) & (ids[:-k] >= 0)
            for word, other in ((ids[:-k], near[k:]), (ids[k:], near[:-k])):
                use = both & (word >= low) & (word < high) if step < n else both
                o = other[use]
                np.add.at(sums, (word[use].astype(np.int64) - low) * dimensions + (o >> 1), (o & 1) * 2 - 1)
        at = np.flatnonzero(sums)
        found.append((at // dimensions + low, at % dimensions, sums[at].astype(np.int64)))
    of, d, x = (np.concatenate(a) for a in zip(*found, strict=True))
    little = np.abs(x) <= FEW
    times = np.abs(x[little])
    marks = np.repeat(d[little] * 2 + (x[little] > 0), times).astype(_mark(dimensions))
    few = _binaries(_offsets(np.repeat(of[little], times), n) * marks.itemsize, marks.tobytes())
    of, d, x = _pieces(of[~little], d[~little], x[~little], dimensions)
    many = _lists(of, x * dimensions + d, n)
    groups, at = np.unique(codes, return_inverse=True)
    use = (ids >= 0) & (codes[text] != np.iinfo(np.int64).min)
    keys, times = np.unique(ids[use].astype(np.int64) * len(groups) + at[text[use]], return_counts=True)
    of, code = keys // len(groups), groups[keys % len(groups)]
    wide = (times >= SHIFT) | (code < 0) | (code >= (1 << 31) // SHIFT)
    tf = _lists(of[~wide], code[~wide] * SHIFT + times[~wide], n)
    yield from _sliced(language, words, few=few, many=many, tf=tf, wide=_lists(of[wide], code[wide] * WIDE_SHIFT + times[wide], n, LONGS))


def pack_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (date, language, term, emotions) to rows that hold those of a batch and group together, in order of their text, compressed."""
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("date")), pc.is_valid(batch.column("language"))))
        if not batch.num_rows:
            continue
        first = _starts(batch, ("date", "language"))
        packed = [_packed(batch.slice(low, high - low)) for low, high in zip(first, np.append(first[1:], batch.num_rows), strict=True)]
        at = pa.array(first)
        yield pa.record_batch([batch.column("date").take(at), batch.column("language").take(at), pa.array(packed, pa.binary())], schema=CUT)


#: Texts one after the other and sizes, as sizes take fewer bytes than places when compressed.
PACK = pa.schema([("text", pa.large_binary()), ("sizes", INTS), ("labels", INTS), ("emotions", INTS)])


def _packed(part: pa.RecordBatch) -> bytes:
    part = part.select(["term", "emotions"]).sort_by("term")
    term, labels = part.column("term"), part.column("emotions")
    lists = (pc.binary_length(term), pc.list_value_length(labels), labels.flatten())
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, PACK, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        text = pc.binary_join(pa.array([term.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")
        writer.write_batch(pa.record_batch([text.cast(pa.large_binary()), *(pa.ListArray.from_arrays([0, len(x)], x.cast(pa.int32())) for x in lists)], schema=PACK))
    return out.getvalue().to_pybytes()


def _unpacked(terms: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, how many emotions each has, and these."""
    row = pa.ipc.open_stream(terms).read_all().combine_chunks().to_batches()[0]
    sizes, labels, emotions = (row.column(k).flatten().to_numpy() for k in (1, 2, 3))
    return _binaries(np.append(0, np.cumsum(sizes)), row.column("text")[0].as_py()).view(pa.string()), labels, emotions


def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``pack_terms`` gave to one row per word of the candidates: the days whose candidates hold it."""
    held: dict[str, list] = {}
    words = 0
    for batch in batches:
        for day, language, terms in zip(batch.column("date").cast(pa.int32()).to_pylist(), *(batch.column(c).to_pylist() for c in ("language", "terms")), strict=True):
            coded = pc.split_pattern(_unpacked(terms)[0], " ").flatten().unique()
            held.setdefault(language, []).append((coded.dictionary_encode(), np.full(len(coded), day)))
            words += len(coded)
            if words >= TOKENS:
                for one in list(held):
                    yield from _asked(one, held.pop(one))
                words = 0
    for language in list(held):
        yield from _asked(language, held.pop(language))


def _asked(language: str, parts: list) -> Iterator[pa.RecordBatch]:
    words, ids = _coded([p[0] for p in parts])
    days, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    keys = np.unique(ids.astype(np.int64) * len(days) + at)
    n = len(words)
    yield from _sliced(language, words, days=_lists(keys // len(days), days[keys % len(days)], n))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Notes in order of (language, word): batches that hold all rows of their words, with the first row of each."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        first = _starts(batch, ("language", "word"))
        if first[-1]:
            yield batch.slice(0, first[-1]), first[:-1]
        rest = batch.slice(first[-1])
    if rest is not None:
        yield rest, _starts(rest, ("language", "word"))


def _starts(batch: pa.RecordBatch, keys: tuple[str, str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in keys:
        a = batch.column(name)
        new[1:] |= pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _entries(a: pa.Array, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(run, _ints(pc.list_value_length(a), 0)), a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(batch: pa.RecordBatch, run: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """What stands around each of ``n`` words, added up."""
    sums = np.zeros(n * dimensions, np.int64)
    few = batch.column("few")
    size = np.dtype(_mark(dimensions)).itemsize
    marks = np.frombuffer(b"".join(few.drop_null().to_pylist()), _mark(dimensions)).astype(np.int64)
    np.add.at(sums, np.repeat(run, _ints(pc.binary_length(few), 0) // size) * dimensions + marks // 2, (marks & 1) * 2 - 1)
    of, many = _entries(batch.column("many"), run)
    np.add.at(sums, of * dimensions + many % dimensions, many // dimensions)
    return sums.reshape(n, dimensions)


def vectors(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """Notes in order of (language, word) to (language, word, vector), scaled to length one."""
    for batch, first in _runs(batches):
        counts = _counts(batch, _spread(first, batch.num_rows), len(first), dimensions).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        use = norm > 0
        x = pa.FixedSizeListArray.from_arrays(pa.array((counts[use] / norm[use, None]).ravel()), dimensions).cast(pa.list_(pa.float64()))
        at = pa.array(first[use])
        yield pa.record_batch({"language": batch.column("language").take(at), "word": batch.column("word").take(at), "x": x})


def _spread(first: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, rows)))


def answer(batches: Iterator[pa.RecordBatch], dimensions: int, emotions: int) -> Iterator[pa.RecordBatch]:
    """Notes in order of (language, word) to (date, language, emotion, word, x).

    With a word: what stands around it, for each day that asks.  With an
    emotion: this task's share of the group's vector.
    """
    groups: dict[str, dict[int, int]] = {}
    sums: dict[str, np.ndarray] = {}
    for batch, first in _runs(batches):
        run = _spread(first, batch.num_rows)
        counts = _counts(batch, run, len(first), dimensions)
        scaled = counts.astype(np.float64)
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        scaled /= np.where(norm > 0, norm, 1.0)[:, None]
        at = pa.array(first)
        languages, words = batch.column("language").take(at), batch.column("word").take(at)
        names = languages.dictionary_encode()
        name = names.indices.to_numpy()
        for column, shift in (("tf", SHIFT), ("wide", WIDE_SHIFT)):
            of, noted = _entries(batch.column(column), run)
            use = norm[of] > 0
            of, noted = of[use], noted[use]
            for k, language in enumerate(names.dictionary.to_pylist()):
                mine = name[of] == k
                if mine.any():
                    _add(groups.setdefault(language, {}), sums, language, of[mine], noted[mine] // shift, noted[mine] % shift, scaled)
        of, days = _entries(batch.column("days"), run)
        use = norm[of] > 0
        yield from _answers(of[use], days[use], counts, languages, words)
    width = max(1, emotions)
    for language, known in groups.items():
        codes = np.fromiter(known, np.int64, len(known))
        x = sums[language]
        for k in range(0, len(codes), ROWS):
            c = codes[k:k + ROWS]
            offsets = np.arange(len(c) + 1) * dimensions * 8
            yield pa.record_batch([pa.array((c // width).astype(np.int32)).cast(pa.date32()), pa.repeat(pa.scalar(language), len(c)), pa.array((c % width).astype(np.int32)),
                                   pa.nulls(len(c), pa.string()), pa.nulls(len(c), pa.binary()), _binaries(offsets, x[k:k + len(c)].astype("<f8").tobytes())], schema=PARTS)


def _add(known: dict[int, int], sums: dict[str, np.ndarray], language: str, of: np.ndarray, codes: np.ndarray, times: np.ndarray, scaled: np.ndarray) -> None:
    """Add what the noted words bring into their groups' vectors."""
    order = np.argsort(codes, kind="stable")
    codes, times, of = codes[order], times[order].astype(np.float64), of[order]
    places = np.array([known.setdefault(c, len(known)) for c in np.unique(codes).tolist()])
    x = sums.get(language)
    if x is None or len(x) < len(known):
        grown = np.zeros((2 * len(known), scaled.shape[1]))
        if x is not None:
            grown[:len(x)] = x
        x = sums[language] = grown
    done = 0
    for k in range(0, len(codes), ENTRIES):
        c = codes[k:k + ENTRIES]
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        if k and c[0] == codes[k - 1]:
            done -= 1                                   # the group goes on from the entries before
        x[places[done:done + len(starts)]] += np.add.reduceat(scaled[of[k:k + ENTRIES]] * times[k:k + ENTRIES, None], starts, axis=0)
        done += len(starts)


def _answers(of: np.ndarray, days: np.ndarray, counts: np.ndarray, languages: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    if not len(of):
        return
    most, marks = np.abs(counts).max(axis=1), np.abs(counts).sum(axis=1)
    rows = lambda m, day, few, x: pa.record_batch([pa.array(day.astype(np.int32)).cast(pa.date32()), languages.take(pa.array(m)), pa.nulls(len(m), pa.int32()), words.take(pa.array(m)),
                                                   pa.nulls(len(m), pa.binary()) if few is None else few, pa.nulls(len(m), pa.binary()) if x is None else x], schema=PARTS)
    dimensions = counts.shape[1]
    little = np.flatnonzero(marks <= dimensions // 2)
    word, d = np.nonzero(counts[little])
    x = counts[little[word], d]
    texts = np.repeat(d * 2 + (x > 0), np.abs(x)).astype(_mark(dimensions))
    offsets = np.append(0, np.cumsum(marks[little])) * texts.itemsize
    texts = _binaries(offsets, texts.tobytes())
    place = np.full(len(counts), -1)
    place[little] = np.arange(len(little))
    use = place[of] >= 0
    mine, day = of[use], days[use]
    for k in range(0, len(mine), ROWS):
        m = mine[k:k + ROWS]
        yield rows(m, day[k:k + ROWS], texts.take(pa.array(place[m])), None)
    of, days = of[~use], days[~use]
    low = 0
    for kind in (np.int8, np.int16, np.int32, np.int64):
        high = np.iinfo(kind).max
        use = (most[of] > low) & (most[of] <= high)
        low = high
        mine, day = of[use], days[use]
        for k in range(0, len(mine), ROWS):
            m = mine[k:k + ROWS]
            x = counts[m].astype(np.dtype(kind).newbyteorder("<"))
            yield rows(m, day[k:k + ROWS], None, _binaries(np.arange(len(m) + 1) * dimensions * x.itemsize, x.tobytes()))


def _whole(held: pa.Table, words: pa.DictionaryArray, dimensions: int) -> np.ndarray:
    """What stands around each of the distinct words, from either form of it."""
    sums = np.zeros((len(words.dictionary), dimensions), np.int64)
    at = words.indices.to_numpy()
    few, x = (held[c].combine_chunks() for c in ("few", "x"))
    marked = few.is_valid().to_numpy(zero_copy_only=False)
    marks = np.frombuffer(b"".join(few.drop_null().to_pylist()), _mark(dimensions)).astype(np.int64)
    # a word may have come twice, if two tasks asked for it
    last = np.zeros(len(words.dictionary), np.int64)
    last[at] = np.arange(len(at))
    row = np.repeat(np.arange(len(at)), _ints(pc.binary_length(few), 0) // np.dtype(_mark(dimensions)).itemsize)
    use = last[at[row]] == row
    np.add.at(sums.ravel(), at[row[use]] * dimensions + marks[use] // 2, (marks[use] & 1) * 2 - 1)
    size = _ints(pc.binary_length(x), 0) // dimensions
    for width in (1, 2, 4, 8):
        mine = np.flatnonzero((size == width) & ~marked)
        sums[at[mine]] = np.frombuffer(b"".join(x.take(pa.array(mine)).to_pylist()), f"<i{width}").reshape(-1, dimensions)
    return sums


def score(terms: pa.Table, parts: pa.Table, dimensions: int, emotions: list[str], top_n: int, digits: int, schema: pa.Schema) -> pa.Table:
    """The best candidates of each emotion of one (date, language) by cosine, ties by term.

    ``terms`` is what ``pack_terms`` gave for the group, ``parts`` what ``answer`` gave.
    """
    groups: dict[int, np.ndarray] = {}
    for e, x in zip(*(parts.filter(pc.is_valid(parts["emotion"]))[c].to_pylist() for c in ("emotion", "x")), strict=True):
        groups[e] = groups.get(e, 0) + np.frombuffer(x, "<f8")
    held = parts.filter(pc.is_valid(parts["word"])).combine_chunks()
    if not groups or not held.num_rows or not terms.num_rows:
        return schema.empty_table()
    date, language = terms["date"][0], terms["language"][0]
    term, labels, label = (pa.concat_arrays(x) if k == 0 else np.concatenate(x) for k, x in enumerate(zip(*map(_unpacked, terms["terms"].to_pylist()), strict=True)))
    words = held["word"].combine_chunks().dictionary_encode()
    unit = _whole(held, words, dimensions).astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    split = pc.split_pattern(term, " ")
    of = np.repeat(np.arange(len(term)), pc.list_value_length(split).to_numpy())
    at = _ints(pc.index_in(split.flatten(), value_set=words.dictionary))
    of, at = of[at >= 0], at[at >= 0]
    if not len(of):
        return schema.empty_table()
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    v = np.add.reduceat(unit[at], starts, axis=0)
    vv = (v * v).sum(axis=1)
    row = np.full(len(term), -1)
    row[of[starts]] = np.arange(len(starts))
    label_of = np.repeat(np.arange(len(term)), labels)
    order = np.empty(len(term), np.int64)
    order[pc.sort_indices(term).to_numpy()] = np.arange(len(term))
    out = []
    for e, g in sorted(groups.items()):
        mine = label_of[label == e]
        mine = mine[row[mine] >= 0]
        n = np.sqrt(vv[row[mine]] * (g * g).sum())
        mine, n = mine[n > 0], n[n > 0]
        cosine = v[row[mine]] @ g / n
        # half up, as Spark rounds
        cosine = np.sign(cosine) * np.floor(np.abs(cosine) * 10.0**digits + 0.5) / 10.0**digits + 0.0
        best = np.lexsort((order[mine], -cosine))[:top_n]
        out.append(pa.table([pa.repeat(date, len(best)), pa.repeat(language, len(best)), pa.array([emotions[e]] * len(best), pa.string()),
                             term.take(pa.array(mine[best])), pa.array(cosine[best]), pa.array(np.arange(1, len(best) + 1, dtype=np.int32))], schema=schema))
    return pa.concat_tables(out)
