"""Row types of the ledger and of the logs about it, as DDL."""

PUTS = "key binary, value binary, timestamp long"
RECORD = f"{PUTS}, sequence_number long, hash binary"
BLOCK = "index long, timestamp long, previous_hash binary, merkle_root binary, hash binary, nonce long, first_sequence long, n_records long"
TXN_OPERATION = "tx_id string, op_seq long, kind string, key binary, value binary"
TXN_EVENT = "tx_id string, event string, ts long, log_pos long"
LOCK = "key binary, tx_id string, mode string"
LOG_ENTRY = "node_id string, index long, term long, kind string, key binary, value binary"
PERMISSION_EVENT = "event_id long, ts long, user_id string, permission string, action string, actor string"
