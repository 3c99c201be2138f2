"""Log rows shared by the reader and stream tests."""

T0 = 1_700_000_000_000


def iso(offset_ms):
    seconds, ms = divmod(offset_ms, 1000)
    return f"2023-11-14T22:{13 + (20 + seconds) // 60:02d}:{(20 + seconds) % 60:02d}.{ms:03d}Z"


def usage_event(ms, total_tokens, model=None, **counters):
    info = {"total_token_usage": {"total_tokens": total_tokens, **counters}}
    payload = {"type": "token_count", "info": info} | ({"model": model} if model else {})
    return {"timestamp": iso(ms), "type": "event_msg", "payload": payload}


def event(kind, seq, data, **more):
    return {"type": kind, "seq": seq, "time": T0 + seq, "data": data, **more}


def assistant(ms, mid, inp, out, **more):
    usage = {"input_tokens": inp, "output_tokens": out, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 20}
    return {"type": "assistant", "timestamp": iso(ms), "message": {"id": mid, "model": "m", "usage": usage}, **more}
