"""The relations of the mail model, as explicit Spark schemas."""

ACCOUNTS = "id string, email string, display_name string, imap_host string, imap_port int, auth_kind string, keyring_ref string, created_at timestamp, updated_at timestamp"
MAILBOXES = "id string, account_id string, name string, delimiter string, uid_validity bigint, uid_next bigint, last_seen_uid bigint, last_synced_at timestamp"
MESSAGES = (
    "id string, account_id string, mailbox_id string, imap_uid bigint, rfc822_message_id string, thread_id string, subject string, sender string, sender_email string, sender_domain string, "
    "recipients string, sent_at timestamp, received_at timestamp, snippet string, body_plain string, body_html string, has_attachments boolean, is_deleted boolean, raw_size bigint, created_at timestamp"
)
CHUNKS = "id string, message_id string, chunk_index int, text string, embedding array<float>, embedding_dim int, embedding_model string, created_at timestamp"
SYNC_STATE = "account_id string, last_sync_at timestamp, last_error string, is_running boolean"
FEEDBACK = "id string, query_text string, message_id string, action string, rank int, score double, created_at timestamp"
SETTINGS = "key string, value string, updated_at timestamp"
VERSIONS = "version int, description string, applied_at timestamp"

TABLES = {"accounts": ACCOUNTS, "mailboxes": MAILBOXES, "messages": MESSAGES, "chunks": CHUNKS, "sync_state": SYNC_STATE, "search_feedback": FEEDBACK, "app_settings": SETTINGS, "schema_versions": VERSIONS}

#: Tables that others are made of, or that are made of others.
CHUNK_VECTORS = "id string, embedding array<float>, embedding_dim int, embedding_model string"
#: A sketch of the messages of each batch of vectors.
VECTOR_SKETCHES = "sketch binary"
STORED = TABLES | {"chunk_vectors": CHUNK_VECTORS, "vector_sketches": VECTOR_SKETCHES}
