"""Schemas of the engine's tables."""

from __future__ import annotations

TOKEN = "struct<index:int,list:array<int>,tag:string,text:string,dep:string,synid:int,semantic:string>"
SENTENCE = f"id string, topic string, tokenList array<{TOKEN}>"
POSTING = "word string, tag string, shard int, sentence_id string, offset int, topic string, score double"
TOPIC_INDEX = "word string, tag string, topic string, score double"
KB_ENTRY = "id string, topic string, json_data string"
KB_SCHEMA = "id string, name string, origin string, field_list array<struct<name:string,semantic:string,aiml:string>>"
USER = "email string, first_name string, surname string, salt string, password_hash string"
SESSION = "email string, first_name string, surname string, session string"
LOG = "when long, who string, what string"
TUPLE = "id long, lhs array<long>, predicate long, rhs array<long>"
VOCAB = "id long, word string, is_predicate boolean"
