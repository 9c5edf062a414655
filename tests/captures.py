"""An invented office capture: conversations built packet by packet."""

SCHEMA = ("frame_number long, timestamp double, source_ip string, destination_ip string, source_port long, destination_port long, "
          "protocol string, packet_length long, is_source_client boolean, tcp_flags_syn boolean, tcp_flags_ack boolean, tcp_flags_psh boolean, "
          "tcp_flags_rst boolean, tcp_flags_fin boolean, tcp_sequence_number long, tcp_acknowledgment_number long, tcp_window_size long, tcp_payload_length long, "
          "ip_id long, icmp_type long, icmp_code long, icmp_original_destination_ip string, icmp_original_destination_port long, "
          "icmp_original_protocol string, icmp_original_ip_id long, sni string, tls_handshake_type string, tls_effective_version string, "
          "tls_alert_level string, tls_alert_message_description string, tls_cert_is_self_signed boolean, dns_query_name string, "
          "dns_response_code string, dns_response_addresses array<string>, http_request_method string, http_request_uri string, "
          "http_request_host_header string, http_response_code long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

PRINTER, DESK, NAS, PROXY, SHOP, RESOLVER, ROUTER = ("192.168.50.9", "192.168.50.21", "192.168.50.40", "192.168.50.3", "198.18.7.70",
                                                     "192.168.50.1", "192.168.50.254")


class Capture:
    """Collects packets; ``say`` adds one from a conversation's client or server."""

    def __init__(self):
        self.rows = []

    def packet(self, at, src, dst, sport, dport, protocol="TCP", flags="", client=True, **fields):
        row = dict.fromkeys(NAMES)
        row.update(frame_number=len(self.rows) + 1, timestamp=at, source_ip=src, destination_ip=dst, source_port=sport, destination_port=dport,
                   protocol=protocol, is_source_client=client, packet_length=60)
        if protocol in ("TCP", "HTTP"):
            row.update({f"tcp_flags_{n}": n[0] in flags for n in ("syn", "ack", "psh", "rst", "fin")})
        row.update(fields)
        self.rows.append(tuple(row[n] for n in NAMES))

    def talk(self, client, server, cport, sport):
        def say(at, flags="", server_side=False, **fields):
            if server_side:
                self.packet(at, server, client, sport, cport, flags=flags, client=False, **fields)
            else:
                self.packet(at, client, server, cport, sport, flags=flags, **fields)
        return say

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)


def office():
    """A finished print job, a refused login, an unanswered backup, a TLS failure, a proxy that wants a password."""
    c = Capture()
    job = c.talk(DESK, PRINTER, 40111, 9100)
    job(10.0, "s", tcp_sequence_number=700)
    job(10.03, "sa", True, tcp_sequence_number=9000, tcp_acknowledgment_number=701)
    job(10.04, "a")
    job(10.2, "pa", packet_length=1400)
    job(11.5, "pa", True, packet_length=90)
    login = c.talk(DESK, NAS, 40222, 22)
    login(20.0, "s")
    login(20.4, "ra", True)
    backup = c.talk(DESK, "198.18.7.88", 40333, 873)
    backup(30.0, "s", ip_id=4321)
    c.packet(31.0, ROUTER, DESK, 0, 0, "ICMP", client=False, icmp_type=11, icmp_code=0, icmp_original_destination_ip="198.18.7.88",
             icmp_original_destination_port=873, icmp_original_protocol="TCP", icmp_original_ip_id=4321)
    shop = c.talk(DESK, SHOP, 40444, 443)
    shop(40.0, "s")
    shop(40.1, "pa", sni="shop.test", tls_handshake_type="ClientHello", tls_effective_version="TLS 1.0")
    shop(40.6, "pa", True, tls_alert_level="fatal", tls_alert_message_description="bad_certificate")
    proxy = c.talk(DESK, PROXY, 40555, 3128)
    proxy(50.0, "pa", protocol="HTTP", http_request_method="CONNECT")
    proxy(50.1, "pa", True, protocol="HTTP", http_response_code=407)
    c.packet(60.0, DESK, RESOLVER, 40666, 53, "UDP", dns_query_name="files.test", dns_response_addresses=[NAS])
    c.packet(65.0, "192.168.50.77", RESOLVER, 0, 0, "ICMP", client=False, icmp_type=3, icmp_code=1)
    return c
