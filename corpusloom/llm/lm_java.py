"""The language model's loops over bits, as a Java class that runs in the executors' JVMs: as lm_score.py's arrays do, one event after the other.

Spark's own compiler of generated code (Janino) makes the class on the driver; executors get it as a jar. A task reads rows and gives rows:

| mode | reads | gives |
|-|-|-|
| tally, cells | text | block, counts: of slots (of rounded inputs), as slot_counts() adds them up |
| look | doc_id, text | a row with sums for each text, and one for each of its words that isn't in the dictionary |
| letters, study | token | block, counts: of the spelling's slots; sums: of a round of learning |
| spell | token, c | token, c, log |
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SOURCE = r"""
package corpusloom;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.ArrayDeque;
import java.util.Arrays;
import java.util.HashMap;
import java.util.Iterator;
import java.util.Map;
import org.apache.spark.TaskContext;
import org.apache.spark.api.java.function.FlatMapFunction;
import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

public final class LmTask implements FlatMapFunction, Iterator {
    static final int ORDERS = 6, BINS = 33, INPUTS = 4, BLOCK = 1 << 14;
    static final float TOP = 12f;

    final String mode;
    final Broadcast shared;

    transient HashMap data;
    transient Iterator rows;
    transient ArrayDeque ready;
    transient boolean ended;
    transient long row;

    // the dictionary and its tree
    transient byte[] words, frequent;
    transient int[] wordEnds, heads, marks, at, path, one, two, bits;
    transient float[] n0, n1, stretched, share1, weights, map;
    transient double[] tail, base;
    transient int escape, levels, turn;
    transient float level, rate;
    transient long[] found;
    // a text: its bytes, and of each token where it begins and ends, its symbol and its hash
    transient byte[] text;
    transient int[] from, to, ids, hashes;
    transient int tokens;
    transient int[] past, touched;
    transient int touches;
    transient float[] x;
    // the spelling
    transient int[] table, spellBits, spellFirst, letters, slots;
    transient double[] slope, curve, zeros, ones;

    public LmTask(String mode, Broadcast shared) {
        this.mode = mode;
        this.shared = shared;
    }

    // what the driver has sent

    ByteBuffer raw(String name) { return ByteBuffer.wrap((byte[]) data.get(name)).order(ByteOrder.LITTLE_ENDIAN); }

    int[] ints(String name) {
        if (data.get(name) == null) return null;
        int[] out = new int[raw(name).remaining() / 4];
        raw(name).asIntBuffer().get(out);
        return out;
    }

    float[] floats(String name) {
        if (data.get(name) == null) return null;
        float[] out = new float[raw(name).remaining() / 4];
        raw(name).asFloatBuffer().get(out);
        return out;
    }

    double[] doubles(String name) {
        if (data.get(name) == null) return null;
        double[] out = new double[raw(name).remaining() / 8];
        raw(name).asDoubleBuffer().get(out);
        return out;
    }

    void open() {
        data = (HashMap) shared.value();
        ready = new ArrayDeque();
        weights = floats("weights");
        map = floats("map");
        if (data.get("words") != null) {
            words = (byte[]) data.get("words");
            frequent = (byte[]) data.get("frequent");
            wordEnds = ints("word_ends");
            at = ints("at");
            path = ints("path");
            bits = ints("bits");
            one = ints("one");
            two = ints("two");
            n0 = floats("n0");
            n1 = floats("n1");
            stretched = floats("stretched");
            share1 = floats("share1");
            tail = doubles("tail");
            base = doubles("base");
            double[] numbers = doubles("numbers");
            level = (float) numbers[0];
            levels = (int) numbers[1];
            turn = (int) numbers[2];
            rate = (float) numbers[3];
            escape = wordEnds.length;
            int size = 16;
            while (size < 2 * escape) size *= 2;
            heads = new int[size];
            marks = new int[escape];
            for (int w = 0; w < escape; w++) {
                int lo = w == 0 ? 0 : wordEnds[w - 1];
                marks[w] = xxh32(words, lo, wordEnds[w] - lo);
                int h = marks[w] & (size - 1);
                while (heads[h] != 0) h = (h + 1) & (size - 1);
                heads[h] = w + 1;
            }
            past = new int[2 * n0.length];
            touched = new int[n0.length];
            x = new float[INPUTS];
            from = new int[1024];
            to = new int[1024];
            ids = new int[1024];
            hashes = new int[1024];
        } else {
            table = ints("table");
            spellBits = ints("bits");
            spellFirst = ints("first");
            letters = new int[ORDERS];
            slots = new int[ORDERS];
            x = new float[ORDERS];
        }
    }

    static int scrambled(int v) {
        v = (v ^ (v >>> 16)) * 0x85EBCA6B;
        return (v ^ (v >>> 13)) * 0xC2B2AE35;
    }

    static int int32(byte[] b, int i) { return (b[i] & 255) | (b[i + 1] & 255) << 8 | (b[i + 2] & 255) << 16 | (b[i + 3] & 255) << 24; }

    static int xxh32(byte[] b, int i, int n) {
        int end = i + n, h;
        if (n >= 16) {
            int v1 = 0x9E3779B1 + 0x85EBCA77, v2 = 0x85EBCA77, v3 = 0, v4 = -0x9E3779B1;
            for (; i + 16 <= end; i += 16) {
                v1 = Integer.rotateLeft(v1 + int32(b, i) * 0x85EBCA77, 13) * 0x9E3779B1;
                v2 = Integer.rotateLeft(v2 + int32(b, i + 4) * 0x85EBCA77, 13) * 0x9E3779B1;
                v3 = Integer.rotateLeft(v3 + int32(b, i + 8) * 0x85EBCA77, 13) * 0x9E3779B1;
                v4 = Integer.rotateLeft(v4 + int32(b, i + 12) * 0x85EBCA77, 13) * 0x9E3779B1;
            }
            h = Integer.rotateLeft(v1, 1) + Integer.rotateLeft(v2, 7) + Integer.rotateLeft(v3, 12) + Integer.rotateLeft(v4, 18);
        } else h = 0x165667B1;
        h += n;
        for (; i + 4 <= end; i += 4) h = Integer.rotateLeft(h + int32(b, i) * 0xC2B2AE3D, 17) * 0x27D4EB2F;
        for (; i < end; i++) h = Integer.rotateLeft(h + (b[i] & 255) * 0x165667B1, 11) * 0x9E3779B1;
        h = (h ^ (h >>> 15)) * 0x85EBCA77;
        h = (h ^ (h >>> 13)) * 0xC2B2AE3D;
        return h ^ (h >>> 16);
    }

    static float above(float v) { return v > 0 ? v : 0; }

    static float within(float v, float lo, float hi) { return v < lo ? lo : v > hi ? hi : v; }

    static int seen(float n, float a, float b, float c) { return n >= c ? 3 : n >= b ? 2 : n >= a ? 1 : 0; }

    /** The natural logarithm of a positive, normal number: Cephes' polynomial around one, to about 1e-7. Math.log took several times as long. */
    static float log(float v) {
        int b = Float.floatToRawIntBits(v), e = (b - 0x3F3504F3) >> 23;
        float f = Float.intBitsToFloat(b - (e << 23)) - 1, z = f * f, y = 7.0376836292e-2f;
        y = y * f - 1.1514610310e-1f;
        y = y * f + 1.1676998740e-1f;
        y = y * f - 1.2420140846e-1f;
        y = y * f + 1.4249322787e-1f;
        y = y * f - 1.6668057665e-1f;
        y = y * f + 2.0000714765e-1f;
        y = y * f - 2.4999993993e-1f;
        y = y * f + 3.3333331174e-1f;
        y = y * f * z - e * 2.12194440e-4f - 0.5f * z;
        return f + y + e * 0.693359375f;
    }

    /** The exponential function, likewise. */
    static float exp(float v) {
        v = within(v, -87, 87);
        int n = (int) (v * 1.44269504f + 127.5f) - 127;
        float r = v - n * 0.693359375f + n * 2.12194440e-4f, y = 1.9875691500e-4f;
        y = y * r + 1.3981999507e-3f;
        y = y * r + 8.3334519073e-3f;
        y = y * r + 4.1665795894e-2f;
        y = y * r + 1.6666665459e-1f;
        y = y * r + 5.0000001201e-1f;
        return (y * r * r + r + 1) * Float.intBitsToFloat((n + 127) << 23);
    }

    /** The mean of the mixed probability and of the map's. e: exp(-z). */
    float refined(float z, float e, int gate) {
        float place = (z + TOP) * ((BINS - 1) / (2 * TOP));
        int low = Math.min((int) place, BINS - 2);
        float r = map[BINS * gate + low];
        r += (map[BINS * gate + low + 1] - r) * (place - low);
        return within(0.5f / (1 + e) + 0.5f * r, 1e-6f, 1 - 1e-6f);
    }

    // the dictionary's code

    int symbol(int lo, int n, int mark) {
        for (int h = mark & (heads.length - 1); heads[h] != 0; h = (h + 1) & (heads.length - 1)) {
            int w = heads[h] - 1, start = w == 0 ? 0 : wordEnds[w - 1];
            if (marks[w] == mark && Arrays.equals(text, lo, lo + n, words, start, wordEnds[w])) return w;
        }
        return escape;
    }

    void token(int lo, int hi) {
        if (tokens == ids.length) {
            from = Arrays.copyOf(from, 2 * tokens);
            to = Arrays.copyOf(to, 2 * tokens);
            ids = Arrays.copyOf(ids, 2 * tokens);
            hashes = Arrays.copyOf(hashes, 2 * tokens);
        }
        int mark = xxh32(text, lo, hi - lo);
        from[tokens] = lo;
        to[tokens] = hi;
        ids[tokens] = symbol(lo, hi - lo, mark);
        hashes[tokens++] = scrambled(mark);
    }

    /** Words between white space, A-Z lowered, then the end. */
    void read(byte[] bytes) {
        text = bytes == null ? new byte[0] : (byte[]) bytes.clone();
        tokens = 0;
        int start = -1;
        for (int i = 0; i < text.length; i++) {
            byte c = text[i];
            if (c == 32 || c >= 9 && c <= 13) {
                if (start >= 0) token(start, i);
                start = -1;
            } else {
                if (c >= 65 && c <= 90) text[i] = (byte) (c + 32);
                if (start < 0) start = i;
            }
        }
        if (start >= 0) token(start, text.length);
        token(text.length, text.length);
    }

    int before(int i) { return (i > 0 ? hashes[i - 1] * 3 : 0) + (i > 1 ? hashes[i - 2] : 0) + 1; }

    void tally() {
        int s0 = 32 - bits[0], s1 = 32 - bits[1], off = 1 << bits[0], skip = 0;
        for (int i = 0; i < tokens; i++) {
            int c0 = before(i), c1 = skip + 2;
            for (int j = at[ids[i]]; j < at[ids[i] + 1]; j++) {
                int spread = (path[j] >> 1) * 0x9E3779B1;
                long add = 1L << 32 * (path[j] & 1);
                found[((c0 ^ spread) * 0x85EBCA6B) >>> s0] += add;
                found[off + (((c1 ^ spread) * 0x85EBCA6B) >>> s1)] += add;
            }
            if (frequent[ids[i]] != 0) skip = hashes[i];
        }
    }

    /** Inputs of an event, into x, and its gate. own: it is among the counts, and is left out of them. */
    int inputs(int c0, int c1, int node, int bit, boolean own) {
        float zero = own ? 1 - bit : 0, one1 = own ? bit : 0, p1;
        if (own) {
            float a = n0[node] + (0.4f - zero), b = n1[node] + (0.4f - one1);
            x[0] = log(b / a);
            p1 = b / (a + b);
        } else {
            x[0] = stretched[node];
            p1 = share1[node];
        }
        float p0 = 1 - p1, q0 = 2 * p0, q1 = 2 * p1;
        int spread = node * 0x9E3779B1;
        int pair = one[((c0 ^ spread) * 0x85EBCA6B) >>> (32 - bits[0])], other = two[((c1 ^ spread) * 0x85EBCA6B) >>> (32 - bits[1])];
        float m0 = above((pair & 0xFFFF) - zero), m1 = above((pair >>> 16) - one1), seen0 = m0 + m1;
        x[1] = log((m1 + q1) / (m0 + q0));
        m0 = above((other & 0xFFFF) - zero);
        m1 = above((other >>> 16) - one1);
        float seen1 = m0 + m1;
        x[2] = log((m1 + q1) / (m0 + q0));
        m0 = past[2 * node];
        m1 = past[2 * node + 1];
        x[3] = log((m1 + 4 * p1) / (m0 + 4 * p0));
        if (m0 + m1 == 0) touched[touches++] = node;
        past[2 * node + bit]++;
        return (seen(seen0, 1, 2, 8) * 4 + seen(m0 + m1, 1, 4, 24)) * 2 + (seen1 >= 20 ? 1 : 0);
    }

    void forget() {
        while (touches > 0) {
            int node = touched[--touches];
            past[2 * node] = 0;
            past[2 * node + 1] = 0;
        }
    }

    void cells() {
        int skip = 0;
        for (int i = 0; i < tokens; i++) {
            int c0 = before(i), c1 = skip + 2;
            for (int j = at[ids[i]]; j < at[ids[i] + 1]; j++) {
                int bit = path[j] & 1, cell = inputs(c0, c1, path[j] >> 1, bit, true);
                for (int k = 0; k < INPUTS; k++) cell = cell * (2 * levels + 1) + (int) Math.rint(within(x[k] / level, -levels, levels)) + levels;
                found[cell] += 1L << 32 * bit;
            }
            if (frequent[ids[i]] != 0) skip = hashes[i];
        }
        forget();
    }

    /** The natural logarithm of the text's probability by the code's bits. */
    double scored() {
        int skip = 0, events = 0;
        float[] own = new float[INPUTS], squares = new float[INPUTS];
        double[] errors = new double[INPUTS];
        Arrays.fill(squares, 1e-2f);
        double sum = 0, product = 1;
        for (int i = 0; i < tokens; i++) {
            if (i > 0 && i % turn == 0 && events > 0) {
                for (int k = 0; k < INPUTS; k++) {
                    float g = (float) (errors[k] / (events + 1));
                    squares[k] += g * g;
                    own[k] += rate * g / (float) Math.sqrt(squares[k]);
                    errors[k] = 0;
                }
                events = 0;
            }
            int c0 = before(i), c1 = skip + 2;
            for (int j = at[ids[i]]; j < at[ids[i] + 1]; j++) {
                int bit = path[j] & 1, gate = inputs(c0, c1, path[j] >> 1, bit, false), w = INPUTS * gate;
                float z = within(weights[w] * x[0] + weights[w + 1] * x[1] + weights[w + 2] * x[2] + weights[w + 3] * x[3], -TOP, TOP);
                z += own[0] * x[0] + own[1] * x[1] + own[2] * x[2] + own[3] * x[3];
                float e = exp(-z), err = bit - 1 / (1 + e), kept = within(z, -TOP, TOP);
                for (int k = 0; k < INPUTS; k++) errors[k] += x[k] * err;
                float p = refined(kept, kept == z ? e : exp(-kept), gate);
                product *= bit != 0 ? p : 1 - p;
                if (product < 1e-200) {
                    sum += Math.log(product);
                    product = 1;
                }
                events++;
            }
            if (frequent[ids[i]] != 0) skip = hashes[i];
        }
        forget();
        return sum + Math.log(product);
    }

    void look(Object id) {
        double log = scored() / Math.log(10), bases = 0;
        long known = 0, size = tokens;
        HashMap others = null;
        for (int i = 0; i < tokens; i++) {
            size += to[i] - from[i];
            log += tail[ids[i]];
            if (ids[i] < escape) {
                known++;
                bases += base[ids[i]];
            } else {
                if (others == null) others = new HashMap();
                ByteBuffer word = ByteBuffer.wrap(Arrays.copyOfRange(text, from[i], to[i]));
                int[] n = (int[]) others.get(word);
                if (n == null) others.put(word, new int[] {1});
                else n[0]++;
            }
        }
        Long place = Long.valueOf(row++);
        ready.add(RowFactory.create(new Object[] {place, id, null, Long.valueOf(0), Long.valueOf(tokens), Long.valueOf(size), Long.valueOf(known), Double.valueOf(bases), Double.valueOf(log)}));
        if (others == null) return;
        for (Iterator i = others.entrySet().iterator(); i.hasNext();) {
            Map.Entry e = (Map.Entry) i.next();
            ready.add(RowFactory.create(new Object[] {place, null, ((ByteBuffer) e.getKey()).array(), Long.valueOf(((int[]) e.getValue())[0]), null, null, null, null, null}));
        }
    }

    // the spelling: hashes of the bytes before within the word (0 to 4), and of all of them

    int letter(byte[] word, int i, int run) {
        int h = 0;
        for (int k = 1; k < 5; k++) letters[k] = h = scrambled(h + (i >= k ? word[i - k] & 255 : 0) * 0x9E3779B1 + k);
        letters[5] = run ^ i * 0x27D4EB2F;
        return run + scrambled((i < word.length ? word[i] & 255 : 32) + 257 * (i + 1));
    }

    void slots(int node) {
        slots[0] = node;
        for (int k = 1; k < ORDERS; k++) slots[k] = (scrambled(letters[k] + node * 0x9E3779B1) >>> (32 - spellBits[k])) + spellFirst[k];
    }

    void tallyLetters(byte[] word) {
        int run = 0;
        for (int i = 0; i <= word.length; i++) {
            run = letter(word, i, run);
            int c = i < word.length ? word[i] & 255 : 32, node = 1;
            for (int b = 7; b >= 0; b--) {
                int bit = c >> b & 1;
                slots(node);
                long add = 1L << 32 * bit;
                for (int k = 0; k < ORDERS; k++) found[slots[k]] += add;
                node = node << 1 | bit;
            }
        }
    }

    int spellInputs(int bit, int step, boolean own) {
        float zero = own ? 1 - bit : 0, one1 = own ? bit : 0, p1 = 0.5f, total = 0;
        for (int k = 0; k < ORDERS; k++) {
            int pair = table[slots[k]];
            float m0 = above((pair & 0xFFFF) - zero), m1 = above((pair >>> 16) - one1);
            total = m0 + m1;
            p1 = within((m1 + 2 * p1) / (total + 2), 1e-4f, 1 - 1e-4f);
            x[k] = log(p1 / (1 - p1));
        }
        return step * 6 + seen(total, 1, 3, 10) + (total >= 30 ? 1 : 0) + (total >= 100 ? 1 : 0);
    }

    float mixed(int gate) {
        float z = 0;
        for (int k = 0; k < ORDERS; k++) z += weights[ORDERS * gate + k] * x[k];
        return within(z, -TOP, TOP);
    }

    void study(byte[] word) {
        int run = 0;
        for (int i = 0; i <= word.length; i++) {
            run = letter(word, i, run);
            int c = i < word.length ? word[i] & 255 : 32, node = 1;
            for (int b = 7; b >= 0; b--) {
                int bit = c >> b & 1;
                slots(node);
                int gate = spellInputs(bit, 7 - b, true);
                float z = mixed(gate), p = 1 / (1 + exp(-z)), err = bit - p, bend = p * (1 - p);
                for (int k = 0; k < ORDERS; k++) {
                    int g = ORDERS * gate + k;
                    double y = x[k] * bend;
                    slope[g] += x[k] * err;
                    for (int q = 0; q < ORDERS; q++) curve[ORDERS * g + q] += y * x[q];
                }
                int bin = BINS * gate + (int) Math.rint((z + TOP) * ((BINS - 1) / (2 * TOP)));
                if (bit != 0) ones[bin]++;
                else zeros[bin]++;
                node = node << 1 | bit;
            }
        }
    }

    double spelled(byte[] word) {
        int run = 0;
        double sum = 0;
        for (int i = 0; i <= word.length; i++) {
            run = letter(word, i, run);
            int c = i < word.length ? word[i] & 255 : 32, node = 1;
            double product = 1;
            for (int b = 7; b >= 0; b--) {
                int bit = c >> b & 1;
                slots(node);
                int gate = spellInputs(bit, 7 - b, false);
                float z = mixed(gate), p = refined(z, exp(-z), gate);
                product *= bit != 0 ? p : 1 - p;
                node = node << 1 | bit;
            }
            sum += Math.log(product);
        }
        return sum / Math.log(10);
    }

    // rows

    void giveCounts() {
        for (int lo = 0; lo < found.length; lo += BLOCK) {
            int hi = Math.min(lo + BLOCK, found.length);
            boolean any = false, wide = false;
            for (int i = lo; i < hi; i++) {
                any |= found[i] != 0;
                wide |= (found[i] & 0x8000000080000000L) != 0;
            }
            if (!any) continue;
            ByteBuffer out = ByteBuffer.allocate((hi - lo) * (wide ? 16 : 8)).order(ByteOrder.LITTLE_ENDIAN);
            for (int i = lo; i < hi; i++) {
                if (wide) out.putLong(found[i] & 0xFFFFFFFFL).putLong(found[i] >>> 32);
                else out.putLong(found[i]);
            }
            ready.add(RowFactory.create(new Object[] {Long.valueOf(lo / BLOCK), out.array()}));
        }
        found = null;
    }

    void giveSums() {
        ByteBuffer out = ByteBuffer.allocate(8 * (slope.length + curve.length + zeros.length + ones.length)).order(ByteOrder.LITTLE_ENDIAN);
        out.asDoubleBuffer().put(slope).put(curve).put(zeros).put(ones);
        ready.add(RowFactory.create(new Object[] {out.array()}));
    }

    public Iterator call(Object rows) {
        open();
        this.rows = (Iterator) rows;
        row = (long) TaskContext.getPartitionId() << 40;
        int cells = data.get("cells") == null ? 0 : ints("cells")[0];
        if (mode.equals("look") || mode.equals("spell")) return this;
        if (mode.equals("study")) {
            int gates = weights.length / ORDERS;
            slope = new double[gates * ORDERS];
            curve = new double[gates * ORDERS * ORDERS];
            zeros = new double[gates * BINS];
            ones = new double[gates * BINS];
        } else found = new long[cells];
        while (this.rows.hasNext()) {
            byte[] bytes = (byte[]) ((Row) this.rows.next()).get(0);
            if (mode.equals("letters")) tallyLetters(bytes);
            else if (mode.equals("study")) study(bytes);
            else {
                read(bytes);
                if (mode.equals("tally")) tally();
                else cells();
            }
        }
        if (mode.equals("study")) giveSums();
        else giveCounts();
        return ready.iterator();
    }

    public boolean hasNext() {
        while (ready.isEmpty() && rows.hasNext()) {
            Row r = (Row) rows.next();
            if (mode.equals("look")) {
                read((byte[]) r.get(1));
                look(r.get(0));
            } else ready.add(RowFactory.create(new Object[] {r.get(0), r.get(1), Double.valueOf(spelled((byte[]) r.get(0)))}));
        }
        return !ready.isEmpty();
    }

    public Object next() {
        hasNext();
        return ready.remove();
    }

    public void remove() { throw new UnsupportedOperationException(); }
}
"""

NAME = "corpusloom.LmTask"
#: The class in each application's driver, whose executors have the jar.
_CLASSES: dict[str, object] = {}


def _class(spark: SparkSession):
    """The class, compiled once for each application and handed to its executors."""
    app, jvm = spark.sparkContext.applicationId, spark._jvm
    if app not in _CLASSES:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        folder = tempfile.mkdtemp(prefix="corpusloom-")  # the driver serves the jar from here as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(os.path.realpath(folder), "corpusloom-lm.jar")
        made = compiler.getBytecodes()
        with zipfile.ZipFile(path, "w") as z:
            for name in made:
                z.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
        spark.sparkContext._jsc.addJar(path)
        _CLASSES[app] = compiler.getClassLoader().loadClass(NAME)
    return _CLASSES[app]


def sent(spark: SparkSession, arrays: dict[str, np.ndarray | bytes], more_than=None):
    """Arrays by name as a map of bytes in the driver's JVM, with those of another such map."""
    out = spark._jvm.java.util.HashMap()
    if more_than is not None:
        out.putAll(more_than)
    for k, v in arrays.items():
        out.put(k, v if isinstance(v, bytes) else v.astype(v.dtype.newbyteorder("<")).tobytes())
    return out


def shared(spark: SparkSession, arrays):
    """A map of sent() as a broadcast."""
    return spark.sparkContext._jsc.broadcast(arrays)


def rows(df: DataFrame, mode: str, broadcast, schema: str) -> DataFrame:
    """The rows that tasks of a mode make of df's."""
    spark = df.sparkSession
    args = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 2)
    args[0], args[1] = mode, broadcast
    task = _class(spark).getConstructors()[0].newInstance(args)
    kind = spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json())
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD().mapPartitions(task), kind), spark)
