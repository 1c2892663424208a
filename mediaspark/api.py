"""One object for an application: reads give DataFrames, writes replace the library it holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame

from .config import EngineConfig
from .operators import browse, duplicates, knowledge, merging, mutations, recognition, search, stats
from .schemas import Library
from .sources.snapshots import read_snapshot, write_snapshot


class MediaLibrary:
    """Reads and writes over one library; `now` is asked for the time of each write."""

    def __init__(self, library: Library, config: EngineConfig = EngineConfig(), now: Callable[[], datetime] = datetime.now):
        self.library, self.config, self.now = library, config, now

    # Reads

    def library_stats(self) -> DataFrame:
        return stats.library_stats(self.library)

    def knowledge_stats(self) -> DataFrame:
        return stats.knowledge_stats(self.library)

    def photo_grid(self, limit: int = browse.PAGE, offset: int = 0, person_id: int | None = None, search: str | None = None) -> DataFrame:
        return browse.photo_grid(self.library, limit, offset, person_id, search)

    def photo_detail(self, photo_id: int) -> DataFrame:
        return browse.photo_detail(self.library, photo_id)

    def persons(self) -> DataFrame:
        return stats.persons_with_cover(self.library)

    def photo_people(self, photo_id: int) -> DataFrame:
        return stats.photo_people(self.library, photo_id)

    def person_profile(self, person_id: int) -> DataFrame:
        return stats.person_profile(self.library, person_id)

    def appears_with(self, person_id: int, limit: int = 8) -> DataFrame:
        return stats.appears_with(self.library, person_id, limit)

    def photos_brief(self, photo_ids: Sequence[int]) -> DataFrame:
        return browse.photos_brief(self.library, photo_ids)

    def similar_photos(self, photo_id: int, limit: int = 20) -> DataFrame:
        return search.similar_photos(self.library, photo_id, limit)

    def search(self, query: str, encode: Callable[[str], Sequence[float]], limit: int = 100, **filters) -> DataFrame:
        return search.search(self.library, query, encode, self.config, limit, **filters)

    def timeline_buckets(self) -> DataFrame:
        return stats.timeline_buckets(self.library)

    def photos_by_month(self, year: int, month: int, limit: int = browse.PAGE, offset: int = 0) -> DataFrame:
        return browse.photos_by_month(self.library, year, month, limit, offset)

    def recent_runs(self, limit: int = 5) -> DataFrame:
        return browse.recent_scan_runs(self.library, limit)

    def recent_photos(self, limit: int = 20) -> DataFrame:
        return browse.recent_photos(self.library, limit)

    def on_this_day(self, limit: int = 50, today: date | None = None) -> DataFrame:
        return browse.on_this_day_today(self.library, limit, today)

    def duplicate_groups(self, limit: int = 50) -> DataFrame:
        return duplicates.duplicate_groups(self.library, self.config.phash_max_distance, limit)

    def hidden_duplicates(self, limit: int = 200) -> DataFrame:
        return browse.hidden_duplicates(self.library, limit)

    def duplicate_review_count(self) -> DataFrame:
        return duplicates.duplicate_review_count(self.library, self.config.phash_max_distance)

    def albums(self) -> DataFrame:
        return stats.albums(self.library)

    def album_photos(self, album_id: int, limit: int = browse.PAGE, offset: int = 0) -> DataFrame:
        return stats.album_photos(self.library, album_id, limit, offset)

    def review_count(self) -> DataFrame:
        return stats.review_count(self.library)

    def merge_suggestions(self) -> DataFrame:
        return merging.merge_suggestions_detail(self.library)

    def suggestions_for_person(self, person_id: int) -> DataFrame:
        return merging.suggestions_detail(self.library, person_id=person_id)

    def suggestion_count(self) -> int:
        return stats.open_suggestions(self.library).count()

    def all_suggestions(self, limit: int | None = None) -> DataFrame:
        return merging.suggestions_detail(self.library, limit)

    def person_representatives(self, person_id: int) -> DataFrame:
        return merging.representatives_detail(self.library, person_id)

    # Writes

    def keep_duplicate(self, keep_id: int, member_ids: Sequence[int]) -> None:
        self.library = mutations.mark_duplicates(self.library, keep_id, member_ids)

    def dismiss_duplicate_group(self, member_ids: Sequence[int]) -> None:
        self.library = mutations.dismiss_group(self.library, member_ids)

    def restore_duplicate(self, photo_id: int) -> None:
        self.library = mutations.restore_duplicate(self.library, photo_id)

    def create_album(self, name: str) -> int:
        self.library, album = mutations.create_album(self.library, name, self.now())
        return album

    def rename_album(self, album_id: int, name: str) -> None:
        self.library = mutations.rename_album(self.library, album_id, name, self.now())

    def delete_album(self, album_id: int) -> None:
        self.library = mutations.delete_album(self.library, album_id)

    def add_to_album(self, album_id: int, photo_ids: Sequence[int]) -> int:
        self.library, added = mutations.add_to_album(self.library, album_id, photo_ids, self.now())
        return added

    def remove_from_album(self, album_id: int, photo_ids: Sequence[int]) -> None:
        self.library = mutations.remove_from_album(self.library, album_id, photo_ids)

    def rename_person(self, person_id: int, name: str | None) -> None:
        self.library = mutations.rename_person(self.library, person_id, name)

    def delete_person(self, person_id: int) -> None:
        self.library = mutations.delete_persons(self.library, self.library.persons.filter(f"id = {int(person_id)}").select("id"))

    def merge_person_into(self, source: int, target: int) -> None:
        self.library = mutations.merge_persons(self.library, source, target, self.config)

    def reject_merge_suggestion(self, a: int, b: int) -> None:
        self.library = mutations.reject_merge(self.library, a, b)

    def confirm_suggestion(self, face_id: int, person_id: int) -> None:
        self.library = mutations.confirm_face(self.library, face_id, person_id, self.config, self.now())

    def reject_suggestion(self, face_id: int, person_id: int) -> None:
        self.library = mutations.reject_suggestion(self.library, face_id, person_id, self.now())

    def reject_representative(self, person_id: int, face_id: int) -> None:
        self.library = mutations.reject_representative(self.library, person_id, face_id, self.config, self.now())

    def remove_faces_from_person(self, person_id: int, photo_ids: Sequence[int]) -> None:
        self.library = mutations.remove_person_from_photos(self.library, person_id, photo_ids, self.config, self.now())

    def set_favorite(self, photo_id: int, favorite: bool) -> None:
        row = self.library.photos.sparkSession.createDataFrame([(photo_id, favorite)], "id long, value boolean")
        self.library = mutations.set_photo_values(self.library, row, "is_favorite")

    def update_people(self) -> dict[str, int]:
        self.library, report = recognition.update_people(self.library, self.config)
        return report

    def export_knowledge(self, path: str) -> None:
        knowledge.save_backup(knowledge.backup(self.library, self.now()), path)

    def restore_knowledge(self, path: str) -> dict[str, int]:
        self.library, report = knowledge.restore(self.library, knowledge.load_backup(path), self.now())
        return report

    def save(self, root: str) -> str:
        """Write what changed since the version that the library came from, and go on from the new one.

        Another writer's newer version is a Conflict.
        """
        source = self.library.source
        name = write_snapshot(self.library, root, source[1] if source and source[0] == root else None)
        self.library = read_snapshot(self.library.photos.sparkSession, root)
        return name
