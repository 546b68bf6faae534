"""Writes small captures for the tests."""
import socket
import struct

SYN, SYNACK, ACK, PSHACK, FINACK = 0x02, 0x12, 0x10, 0x18, 0x11


def tcp(src, dst, sport, dport, flags, payload=b"", ttl=64):
    seg = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 8192, 0, 0) + payload
    return ipv4(src, dst, 6, seg, ttl)


def udp(src, dst, sport, dport, payload=b"", ttl=64):
    return ipv4(src, dst, 17, struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload, ttl)


def ipv4(src, dst, proto, body, ttl=64):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 7, 0, ttl, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return head + body


def ipv6(src, dst, nxt, body):
    return struct.pack("!IHBB", 6 << 28, len(body), nxt, 60) + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + body


def ethernet(ip, kind=0x0800):
    return b"\x11" * 6 + b"\x22" * 6 + struct.pack("!H", kind) + ip


def sll(ip, kind=0x0800):
    return struct.pack("!HHH", 0, 1, 6) + b"\x50\x7c\x6f\x50\x98\xc4\x00\x00" + struct.pack("!H", kind) + ip


def sll2(ip, kind=0x0800):
    return struct.pack("!HHIHBB", kind, 0, 1, 1, 0, 6) + b"\x50\x7c\x6f\x50\x98\xc4\x00\x00" + ip


def write_pcap(path, packets, link=1, end="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    div = 10 ** 9 if nano else 10 ** 6
    raw = struct.pack(end + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for ts, frame in packets:
        sec = int(ts)
        raw += struct.pack(end + "IIII", sec, round((ts - sec) * div), len(frame), len(frame)) + frame
    path.write_bytes(raw)
    return path


def write_pcapng(path, packets, link=1):
    raw = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    raw += struct.pack("<IIHHII", 1, 20, link, 0, 65535, 20)
    for ts, frame in packets:
        us = round(ts * 1e6)
        pad = (-len(frame)) % 4
        n = 32 + len(frame) + pad
        raw += struct.pack("<IIIIIII", 6, n, 0, us >> 32, us & 0xFFFFFFFF, len(frame), len(frame)) + frame + b"\0" * pad + struct.pack("<I", n)
    path.write_bytes(raw)
    return path
