"""Fixed schemas of the landed tables, as DDL; nothing is ever inferred."""

DEVICES = (
    "config string, position int, name string, driver string, enabled boolean, "
    "measurement string, slave_id int, ip_address string, port int")

# Broker credentials are left out on purpose: they never enter a table.
BROKERS = (
    "config string, broker int, topic string, ip_address string, port int, enabled boolean")

REGISTER_READS = (
    "device_name string, poll_id bigint, poll_ts timestamp, block int, attempt int, "
    "ok boolean, registers array<int>")

HOST_SAMPLES = (
    "host string, ts timestamp, cpu_temp_raw string, cpu_usage double, load1 double, "
    "load5 double, load15 double, ram_cached bigint, ram_used bigint, ram_free bigint, "
    "ram_available bigint, ram_percent double, disk_total bigint, disk_used bigint, "
    "disk_free bigint, disk_percent double")

CPUINFO_LINES = "host string, line_no int, line string"

RUNS = "serial string, config string, minute timestamp"
