"""Print stage and job wall times from a Spark event log folder (zstd or plain)."""

import glob
import json
import sys

import zstandard


def lines(path):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        r = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        chunks = []
        while True:
            b = r.read(1 << 20)
            if not b:
                break
            chunks.append(b)
        raw = b"".join(chunks)
    return raw.decode().splitlines()


def main(folder):
    st, jobs = {}, {}
    for f in sorted(glob.glob(folder.rstrip("/") + "/**/events_*", recursive=True)):
        for line in lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e["Event"] == "SparkListenerStageCompleted":
                i = e["Stage Info"]
                st[i["Stage ID"]] = (i["Stage Name"][:40], i["Number of Tasks"], i["Completion Time"] - i["Submission Time"], i["Submission Time"])
            elif e["Event"] == "SparkListenerJobStart":
                jobs[e["Job ID"]] = e["Submission Time"]
            elif e["Event"] == "SparkListenerJobEnd":
                jobs[e["Job ID"]] = (jobs[e["Job ID"]], e["Completion Time"] - jobs[e["Job ID"]])
    t0 = min(v[3] for v in st.values())
    for k, v in sorted(st.items()):
        print("stage", k, v[:3], "start+", v[3] - t0)
    for k, v in sorted(jobs.items()):
        print("job", k, "start+", v[0] - t0, "ms", v[1])


if __name__ == "__main__":
    main(sys.argv[1])
